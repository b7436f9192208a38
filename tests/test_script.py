"""Scripts' sort keys: compiled, never run; against Python on the same items."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark.functions import script
from quillmark.operators import grid

from .catalogs import files, record

ITEMS = [("/g/IMG_10.jpg", "IMG_10.jpg", "jpeg", 900, 50, 3), ("/g/b.png", "b.png", "png", 7, None, 0), ("/g/Z", "Z", "", 0, 1, 5), ("/g/ü-2.gif", "ü-2.gif", "gif", 2**40, 2, 1)]
SCHEMA = "path string, name string, type string, size long, date_taken long, rating int"
KEYS = {
    "item['size']": None,
    "-item['size'] / 4 + 1": None,
    "item['size'] // 7 * 2 - item['size'] % 7": None,
    "item['name'].lower()": None,
    "item['type'] + '/' + item['name'][:3]": None,
    "item['name'][-4:] + item['name'][0]": None,
    "f\"{item['type']} {len(item['name']):04d} {item['size']}\"": None,
    "{'png': 1, 'jpeg': 2}.get(item['type'], 9)": None,
    "{'png': 'a'}.get(item['type'], 'z') + str(item['rating'])": None,
    "1 if item['rating'] >= 3 and not item['type'] == '' else 2": None,
    "item['date_taken'] or 99": None,
    "5 if item['date_taken'] is None else item['date_taken'] * 2": None,
    "max(item['rating'], 2, len(item['type']))": None,
    "item['name'].replace('.', '').upper().find('2')": None,
    "1 if 'g' in item['name'] else 0": None,
    "(item['name'].startswith('I') + 1) * 2": None,
    "0 < item['rating'] <= 3 and 7 or 8": None,
    "abs(3 - item['rating']) + int(item['size'] / 2)": None,
}


@pytest.mark.parametrize("text", KEYS)
def test_keys_equal_python(spark, text):
    items = spark.createDataFrame(ITEMS, SCHEMA)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    (key,) = script.read_script("s.py", f"register_sort('k', lambda item: {text})").values()
    value = key(items)
    got = {r.path: r.k for r in items.select("path", value.column.alias("k")).collect()}
    want = {r[0]: eval(text, {"item": dict(zip(names, r))}) for r in ITEMS}  # the test's own texts
    assert value.kind == ("str" if isinstance(want["/g/Z"], str) else "num")
    assert {p: v if isinstance(v, str) else float(v) for p, v in got.items()} == {p: v if isinstance(v, str) else float(v) for p, v in want.items()}


REFUSED = {
    "import os": "only register_sort",
    "while True: pass": "only register_sort",
    "register_sort('x', len)": "lambda of one item",
    "register_sort('', lambda item: 1)": "needs a name",
    "register_sort('x', lambda item: __import__('os').system('id'))": "no method",
    "register_sort('x', lambda item: open('/etc/passwd'))": "no function open",
    "register_sort('x', lambda item: item.__class__)": "Attribute",
    "register_sort('x', lambda item: [i for i in range(9)])": "ListComp",
    "register_sort('x', lambda item: (lambda: 1)())": "no such call",
    "register_sort('x', lambda item: item['size'] ** 99)": "Pow",
    "register_sort('x', lambda item: 'a' * 10)": "num expected",
    "register_sort('x', lambda item: item['absent'])": "has no",
    "register_sort('x', lambda item: item['size'] + item['name'])": "num expected",
    "register_sort('x', lambda item: f\"{item['size']:099999d}\")": "no format",
    "register_sort('x', lambda item: 1 if item['size'] else 'a')": "in one place",
    "register_sort('x', lambda item: 10 ** 400)": "Pow",
    "register_sort('x', lambda item: %s)" % "+".join(["1"] * 2000): "more than",
    "(" * 500 + ")" * 500: "s.py",
    "x = 1": "only register_sort",
}


@pytest.mark.parametrize("text", REFUSED)
def test_everything_else_is_refused_by_name(spark, text):
    with pytest.raises(script.ScriptError, match="s.py") as error:
        for key in script.read_script("s.py", text).values():
            key(spark.createDataFrame(ITEMS, SCHEMA))
    assert REFUSED[text] in str(error.value)


def test_a_folder_of_scripts(spark, tmp_path):
    (tmp_path / "a.py").write_text('"""Sizes."""\nregister_sort("Size", lambda it: it["size"])\nregister_sort("None", lambda it: None)\nregister_sort("Gone", lambda it: it["gone"])')
    (tmp_path / "b.py").write_text("register_sort('B', lambda item: item['name'])\nimport os")
    (tmp_path / "c.py").write_bytes(b"\xff\xfe")
    keys = grid.SortKeys()
    errors = keys.load_dir(str(tmp_path))
    assert sorted(errors) == [str(tmp_path / n) for n in ("b.py", "c.py")] and "b.py:2" in errors[str(tmp_path / "b.py")]
    assert "B" not in keys.orders and {"Size", "None", "Gone"} <= keys.native
    c = files(spark, record("/g/big", size=9), record("/g/small", size=1), record("/g/tie", size=1))
    names = lambda order: [r.name for r in keys.sorted_or_by_name(grid.grid(c), order).collect()]
    assert names("Size") == ["small", "tie", "big"] and names("None") == names("Gone") == ["big", "small", "tie"]
    plan = keys.keyed(grid.grid(c), "Size")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_keys_come_last(spark):
    items = spark.createDataFrame(ITEMS, SCHEMA)
    keys = grid.SortKeys()
    keys.orders["Date"] = script.read_script("s", "register_sort('Date', lambda item: item['date_taken'])")["Date"]
    keyed = keys.keyed(items, "Date")
    assert [r.name for r in keyed.orderBy(*keys.order()).collect()] == ["Z", "ü-2.gif", "IMG_10.jpg", "b.png"]
    assert keyed.filter(F.col("sort_key").isNull()).count() == 1
