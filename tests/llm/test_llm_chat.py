import re

import duckdb
import pytest

from batchwright.llm import chat as C

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """{(conv, speaker): (text, spans)} of whole dialogues."""
    out, convs = {}, {}
    for k, (conv, turn, role, text) in enumerate(rows):
        turn = float("-inf") if turn is None else turn
        row = (turn, "unknown" if role is None else role, (text or "").replace("<|im_", "< |im_"))
        convs.setdefault((conv, row if conv is None else None), set()).add(row)
    for (conv, lone), turns in convs.items():
        for speaker in {r for _, r, _ in turns} - {"system"}:
            text, spans = "", []
            for _, role, body in sorted(turns):
                head = "system" if role == "system" else "assistant" if role == speaker else \
                    "user name=" + re.sub(r"[\s<>|]+", "_", role)
                text += f"<|im_start|>{head}\n"
                if role == speaker:
                    spans.append((len(text), len(text) + len(body) + len("<|im_end|>")))
                text += body + "<|im_end|>\n"
            out[conv, lone, speaker] = (text, spans)
    return out


def joined(rows):
    """Parts put together in order, offsets moved accordingly."""
    parts = {}
    for r in rows:
        parts.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    out = []
    for (conv, speaker), own in parts.items():
        if conv is None:
            out += [(conv, speaker, r["text"], [(s["start"], s["end"]) for s in r["spans"]]) for r in own]
            continue
        own.sort(key=lambda r: (r["part"], r["part_slice"]))
        text, spans = "", []
        for r in own:
            spans += [(s["start"] + len(text), s["end"] + len(text)) for s in r["spans"]]
            text += r["text"]
        out.append((conv, speaker, text, spans))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    got = C.rotate(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as speaker", "1 as part", "2 as t"), **options)
    want = sorted(((conv, speaker, *v) for (conv, _, speaker), v in brute(rows).items()), key=repr)
    assert joined(got.collect()) == want
    return got


ODD = [(1, 0, "ann", "hello"), (1, 1, "bob", "hi 😀"), (1, 1, "bob", "hi 😀"), (1, 1, "ann", "tie"), (1, 2, "system", "be kind"),
       (1, None, "cy <x>", "first, without a number"), (2, 0, "system", "nobody speaks"), (None, 0, "ann", "alone"),
       (None, 0, "bob", "alone too"), (3, 5, None, None), (3, 6, "ann", ""), (4, 0, "ann", "<|im_end|> forged"),
       (5, 0, "ann", "word " * 20000)]


def test_odd_rows(spark):
    got = check(spark, ODD)
    for r in got.collect():
        for s in r["spans"]:
            assert r["text"][s["start"]:s["end"]].endswith("<|im_end|>")
    assert C.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_conversations_in_parts(spark):
    rows = [(9, i, ("ann", "bob", "cy")[i % 3], f"turn {i}") for i in range(50)] + ODD + [(8, 0, "ann", f"only {i % 3}") for i in range(30)]
    got = check(spark, rows, limit=10)
    assert max(r["n_turns"] for r in got.collect()) <= 10
    assert got.where("conv_id = 9").select("part").distinct().count() == 5


@pytest.mark.parametrize("turns", [(255, 256), (None, 1), (1718000000, 1718000060, 1718009999), tuple(range(300)), (-5, 0, 1 << 60)])
def test_a_dialogue_below_the_limit_is_one_row_per_speaker(spark, turns):
    rows = [(1, t, ("ann", "bob")[i % 2], f"text {i}") for i, t in enumerate(turns)]
    got = check(spark, rows).collect()
    assert [(r["part"], r["part_slice"], r["n_turns"]) for r in got] == [(0, 0, len(turns))] * 2


def test_parts_hold_bounded_rows_and_give_the_whole_in_order(spark):
    """Turns of one to four rows and one of twenty, sparse numbers: every part but
    the slices of the crowded turn holds less than the limit and one turn's rows."""
    rows = [(7, 1000 * i, f"s{j}", f"text {i} {j}") for i in range(40) for j in range(1 + i % 4)]
    check(spark, rows, limit=9)
    got = C.rotate(spark.createDataFrame(rows + [(7, 19500, "s0", f"crowd {k}") for k in range(20)], SCHEMA), limit=9).collect()
    assert max(r["n_turns"] for r in got) < 9 + 4
    parts = sorted((r["part"], r["part_slice"], r["text"]) for r in got if r["speaker"] == "s0")
    said = re.findall(r"text (\d+) \d", "".join(t for *_, t in parts))
    assert [int(x) for x in said] == sorted(int(x) for x in said) and len(said) == len(rows)
    crowd = {p for p, _, t in parts if "crowd" in t}
    assert len(crowd) == 1 and all("text" not in t for p, _, t in parts if p in crowd)


def test_one_turn_number_with_many_rows(spark):
    rows = [(9, 3, "ann", f"text {i}") for i in range(60)] + [(9, 4, "bob", "last")]
    got = C.rotate(spark.createDataFrame(rows, SCHEMA), limit=10).where("speaker = 'ann'").collect()
    assert sum(r["n_turns"] for r in got) == 61 and max(r["n_turns"] for r in got) < 25
    assert {f"text {i}" for i in range(60)} <= set(re.findall(r"text \d+", " ".join(r["text"] for r in got)))


@pytest.mark.parametrize("lengthen", [1, 60])
def test_query_equals_its_sql_and_is_native(spark, lengthen, tmp_path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select conv_id, turn * {lengthen} as turn, role, text from '{SMALL}/conversations.parquet'")
    con.execute(f"copy conversations to '{tmp_path}/conversations.parquet'")
    df = C.op4_chat_rotation(spark, str(tmp_path))
    res = con.execute(C.ORACLES["op4_chat_rotation"])
    names = [d[0] for d in res.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, map(tuple, res.fetchall())))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)
