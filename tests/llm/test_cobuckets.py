from __future__ import annotations

import datetime
import hashlib
import random
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmark.llm import cobuckets
from quillmark.plans.components import shared_folder

from ..conftest import DATA

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def crc(text: str) -> int:
    return zlib.crc32(text.encode()) % 600


def own_bucket(sale) -> int:
    return 601 if sale is None else crc(f"s{sale}")


def in_order(row):
    return [(v is not None, v.encode() if isinstance(v, str) else v) if v is not None else (False,) for v in row]


def sha(values) -> str:
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def brute(sales, lines):
    """(table, bucket) -> rows in order, lineage, joined rows, stays."""
    known: dict = {}
    for s in sales:
        if s[0] is not None:
            known[s[0]] = known.get(s[0], 0) + 1
    place = {"sales": lambda r: (b := own_bucket(r[0])) - (b % 4 == 1), "sale_lines": lambda r: 0 if r[2] is None else crc(str(r[2]))}
    target = {"sales": lambda r: own_bucket(r[0]), "sale_lines": lambda r: 600 if r[0] is not None and r[0] not in known else own_bucket(r[0])}
    joined: dict = {}
    for r in lines:
        if r[0] in known:
            joined[own_bucket(r[0])] = joined.get(own_bucket(r[0]), 0) + known[r[0]]
    out = {}
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        start: dict = {}
        final: dict = {}
        for r in rows:
            start.setdefault(place[name](r), []).append(r)
            final.setdefault(target[name](r), []).append(r)
        for b, own in final.items():
            own = sorted(own, key=in_order)
            from_ = {}
            for r in own:
                from_[place[name](r)] = from_.get(place[name](r), 0) + 1
            stays = len(from_) == 1 and len(start[next(iter(from_))]) == len(own)
            out[name, b] = (own, sha(f"{s}:{n}" for s, n in sorted(from_.items())), joined.get(b, 0), stays)
    return out


def tables(spark, sales, lines):
    folder = f"{shared_folder(spark)}/quillmark/test-{random.getrandbits(60):x}"
    first = cobuckets.Numbered("sales", sales, "sale_id", cobuckets.sales_file(F.col("sale_id")), folder)
    second = cobuckets.Numbered("sale_lines", lines, "sale_id", cobuckets.lines_file(F.col("item_id")), folder)
    return folder, cobuckets.cobucketed(first, second)


def rows_of(path) -> list[tuple]:
    return [tuple(r.values()) for r in pq.ParquetFile(path).read().to_pylist()]


def holds(got, want, columns):
    assert got.columns[:9] == ["table_name", "bucket", "path", "n_rows", "columns", "ids_sha256", "lineage_sha256", "n_joined", "rewritten"]
    found = got.collect()
    assert {(r.table_name, r.bucket) for r in found} == set(want) and len(found) == len(want)
    for r in found:
        rows, lineage, joined, stays = want[r.table_name, r.bucket]
        assert rows_of(r.path) == rows, (r.table_name, r.bucket)
        assert r.ids_sha256 == sha("" if x[0] is None else x[0] for x in rows)
        assert (r.n_rows, r.lineage_sha256, r.n_joined, r.rewritten) == (len(rows), lineage, joined, not stays)
        assert r.columns == ",".join(columns[r.table_name]) == ",".join(pq.ParquetFile(r.path).schema_arrow.names)
    return found


def test_whole_tables_match_brute_force(spark):
    got = cobuckets.op12_cobuckets(spark, DATA)
    sales, lines = (rows_of(f"{DATA}/{t}.parquet") for t in ("sales", "sale_lines"))
    columns = {t: pq.ParquetFile(f"{DATA}/{t}.parquet").schema_arrow.names for t in ("sales", "sale_lines")}
    found = holds(got, brute(sales, lines), columns)
    root = Path(found[0].path).parents[2]
    assert sorted(str(p) for p in root.rglob("*.parquet")) == sorted(r.path for r in found)
    assert not any(p.name.startswith("_") for p in root.rglob("*"))
    kinds = {t: pq.ParquetFile(f"{DATA}/{t}.parquet").schema_arrow for t in ("sales", "sale_lines")}
    assert all(pq.ParquetFile(r.path).schema_arrow.types == kinds[r.table_name].types for r in found)


def shop(seed: int, n: int):
    rng = random.Random(seed)
    when = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(10**6)) if rng.random() < 0.9 else None
    sales = [(rng.choice([None, i, i, i, i // 3]), rng.randrange(9), rng.choice([None, "", "é", "z", "Z"]), rng.choice([None, 1.5, -0.5]), when(), when(), rng.choice([None, 1, 2])) for i in range(n)]
    lines = [(rng.choice([None, 7, 7, 7, rng.randrange(3 * n)]), rng.randrange(3), rng.choice([None, 5, 5, 5, rng.randrange(n)]), None, rng.randrange(4), 0.5 * rng.randrange(9), None, rng.choice(["a", None]), when()) for _ in range(6 * n)]
    return sales, lines + lines[: n // 2] + [lines[3]] * n


@pytest.mark.parametrize("hot", [10, 20_000])
def test_hot_keys_nulls_and_repeated_rows(spark, hot, monkeypatch):
    monkeypatch.setattr(cobuckets, "HOT_ROWS", hot)
    sales, lines = shop(hot, 120)
    folder, got = tables(spark, spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(lines, LINES).repartition(4))
    columns = {"sales": [c.split()[0] for c in SALES.split(", ")], "sale_lines": [c.split()[0] for c in LINES.split(", ")]}
    found = holds(got, brute(sales, lines), columns)
    assert any(r.bucket == 600 for r in found) and any(r.bucket == 601 for r in found)
    assert sorted(str(p) for p in Path(folder.removeprefix("file:")).rglob("*.parquet")) == sorted(r.path for r in found)


def test_a_full_filter_leaves_the_join_exact(spark, monkeypatch):
    monkeypatch.setattr(cobuckets, "bloom", lambda table, key: cobuckets.np.full(cobuckets.SLOTS // 8, 255, cobuckets.np.uint8))
    sales, lines = shop(3, 40)
    _, got = tables(spark, spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES))
    columns = {"sales": [c.split()[0] for c in SALES.split(", ")], "sale_lines": [c.split()[0] for c in LINES.split(", ")]}
    holds(got, brute(sales, lines), columns)


def test_the_filter_knows_every_key_and_few_others(spark):
    keys = spark.range(0, 20_000, 2).repartition(3)
    bits = cobuckets.bloom(keys.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id")), "id")
    asked = spark.range(20_000).withColumn("maybe", cobuckets.might_hold(spark, bits, F.col("id"))).groupBy((F.col("id") % 2).alias("odd"), "maybe").count().collect()
    found = {(r.odd, r.maybe): r["count"] for r in asked}
    assert found[0, True] == 10_000 and found.get((1, True), 0) < 50
    assert not spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(cobuckets.might_hold(spark, bits, F.col("id"))).first()[0]


def test_clashing_columns_and_empty_tables(spark):
    sales = spark.createDataFrame([], SALES)
    lines = spark.createDataFrame([(1, 1, 2, 3, 4, 1.0, 0.0, "x", None), (None, 1, None, 3, 4, 1.0, 0.0, "y", None)], LINES).withColumns({c: F.lit(c) for c in ("_number", "_to", "_maybe", "_key", "_copy", "_range", "bucket", "c0", "c1")})
    _, got = tables(spark, sales, lines)
    found = {r.bucket: r for r in got.collect()}
    assert set(found) == {600, 601} and found[600].n_joined == 0 and found[601].path.endswith("00000.parquet")
    assert pq.ParquetFile(found[600].path).schema_arrow.names == lines.columns
    _, got = tables(spark, sales, lines.limit(0))
    assert got.count() == 0 and len(got.columns) == 9
