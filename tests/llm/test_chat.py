from __future__ import annotations

from quillmark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string, perspective int"


def brute(rows):
    talks: dict = {}
    for c, t, r, x, *_ in rows:
        talks.setdefault(c, set()).add((t is None, t or 0, r or "unknown", x or ""))
    out = []
    for c, said in talks.items():
        for p in {r for *_, r, _ in said if r != "system"}:
            groups: dict = {}
            for late, t, r, x in sorted(said):
                groups.setdefault(-1 if late else t // chat.SEGMENT, []).append((r, x))
            for segment, items in groups.items():
                text, mask = "", []
                for r, x in items:
                    text += "<|assistant|>\n" if r == p else f"<|{r}|>\n" if r == "system" else f"<|user|> {r}:\n"
                    if r == p:
                        mask.append((len(text), len(text) + len(x) + len(chat.END)))
                    text += x + chat.END + "\n"
                out.append((c, p, segment, len(items), text, tuple(mask)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rows = [(c, t, ["user", "assistant", "Ann", "système", None][(c + t) % (2 + c % 4)], f"message {c} {t} é😀" * (t % 3), "x", 1) for c in range(9) for t in range(1 + 23 * c)]
    rows += [(1, 0, "system", "rules", "", 0), (77, 0, "system", "alone", "", 0), (None, 1, "user", "lost", None, None), (None, None, "bob", None, "", 0), rows[3], rows[3], (2, 5, "Ann", "same turn", "", 0), (2, 5, "Ann", "same turn too", "", 0), (3, None, "user", "no turn", "", 0)]
    got = chat.perspectives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.conv_id, r.perspective, r.segment, r.n_messages, r.text, tuple(tuple(s) for s in r["mask"])) for r in got), key=repr) == brute(rows)
    for r in got:
        assert all(r.text[s.start : s.end].endswith(chat.END) and r.text[: s.start].endswith("<|assistant|>\n") for s in r["mask"])


def test_one_hot_turn_is_split(spark):
    rows = [(1, 3, "user" if i % 2 else "bot", f"m{i}", "", 0) for i in range(3000)] + [(1, 70, "user", "later", "", 0)]
    got = chat.perspectives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert max(r.n_messages for r in got) < 2 * chat.PART_ROWS
    assert sum(r.n_messages for r in got) == 2 * 3001
    assert sum(len(r["mask"]) for r in got if r.perspective == "bot") == 1500


def test_empty_table_and_long_text(spark):
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
    got = chat.perspectives(spark.createDataFrame([(1, 0, "a", "long " * 200000, "", 0)], SCHEMA)).first()
    assert len(got.text) == 1000000 + len("<|assistant|>\n" + chat.END) + 1


def test_large_segments_are_cut_by_place(spark):
    rows = [(1, i // 5, f"r{i % 2}", f"m{i}", "", 0) for i in range(257)]
    rows += [(None, 3, "user" if i % 2 else "bot", f"m{i} é", "", 0) for i in range(1100)] + [(None, i, "bot", "x", "", 0) for i in range(60)]
    rows += [(2, None, "a", f"late {i}", "", 0) for i in range(600)] + [(2, 64 + i % 64, "a", f"m{i}", "", 0) for i in range(256)]
    said: dict = {}
    for c, t, r, x, *_ in rows:
        said.setdefault((c, -1 if t is None else t // chat.SEGMENT), set()).add((t or 0, r, x))
    want = []
    for (c, segment), items in said.items():
        for p in {r for d, t, r, *_ in rows if d == c}:
            for part in range(-(-len(items) // chat.PART_ROWS)):
                text, mask = "", []
                for _, r, x in sorted(items)[part * chat.PART_ROWS : (part + 1) * chat.PART_ROWS]:
                    text += "<|assistant|>\n" if r == p else f"<|user|> {r}:\n"
                    if r == p:
                        mask.append((len(text), len(text) + len(x) + len(chat.END)))
                    text += x + chat.END + "\n"
                want.append((c, p, segment, part, text, tuple(mask)))
    got = chat.perspectives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.conv_id, r.perspective, r.segment, r.part, r.text, tuple(tuple(s) for s in r["mask"])) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(r.n_messages for r in got if r.conv_id == 1) == [1, 1, 256, 256]
