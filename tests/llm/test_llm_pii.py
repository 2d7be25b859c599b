import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from batchwright.llm import pii as P
from batchwright.llm.common import table
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        two = [int(c) for c in reversed(digits)]
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(two)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(x, text) if right(k, m[0])] for k, x in PLAIN.items()}


def low(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def brute(texts, support=P.MIN_SUPPORT, least=P.MIN_CONFIDENCE, rounds=P.ROUNDS):
    """By row: spans of every kind, by the rules of the module's docstring over plain Python sets."""
    rows, edges, followers = [], {}, {}
    for text in texts:
        text = text or ""
        spans, near = base(text), []
        flat = [x for k in P.KINDS for x in spans[k]]
        last = 0
        for m in re.finditer(r"(?<![^\t-\r ])[^\t-\r ]*[0-9@][^\t-\r ]*", text):
            before, last = low(text[last:m.start()])[-P.REACH:], m.end()
            words = re.findall(r"(?:^|(?<=[\t-\r ]))([^\t-\r ]+)[\t-\r ]+([^\t-\r ]+)[\t-\r ]+$", before)
            if not words:
                continue
            lead = len(m[0]) - len(re.sub("^[^A-Za-z0-9+]+", "", m[0]))
            core = re.match("(?s)(.*[A-Za-z0-9])?", m[0][lead:])[0] if len(m[0]) <= 256 else ""
            seed = [text[s:e] for s, e in flat if s < m.end() and e > m.start()][:1]
            ident = bool(seed) or bool(re.search(P.SHAPE, core)) and len(re.findall("[0-9]", core)) >= P.MIN_DIGITS
            p, x = " ".join(words[0]), (seed or [core])[0]
            old = edges.get((p, x), (False, False))
            edges[p, x] = old[0] or bool(seed), old[1] or ident
            followers.setdefault(p, set()).add((x,))
            near.append((p, m.start() + lead, m.start() + lead + len(core), bool(seed), ident))
        rows.append((spans, near))
        words = [w for w in re.split("[\t-\r ]+", low(text))]
        for a, b, c in zip(words, words[1:], words[2:]):
            if c and not re.search("[0-9@]", c):
                followers.setdefault(f"{a} {b}", set()).add(c)
    idents = Counter(p for (p, _), (_, i) in edges.items() if i)
    known = {p for p, n in idents.items() if n >= support}
    edges = {k: s for k, (s, i) in edges.items() if i and k[0] in known}
    seeds = {x for (_, x), s in edges.items() if s}
    scores, active = dict.fromkeys(seeds, 1000), {}
    for _ in range(rounds):
        sums, known = Counter(), Counter()
        for p, x in edges:
            if x in scores:
                sums[p] += scores[x]
                known[p] += 1
        active = {p: s // len(followers[p]) for p, s in sums.items()
                  if known[p] >= support and s // len(followers[p]) >= least}
        scores = dict.fromkeys(seeds, 1000)
        for (p, x), s in edges.items():
            if x not in seeds and p in active:
                scores[x] = max(scores.get(x, 0), active[p])
    return [{**spans, "context": sorted({(s, e) for p, s, e, seed, ident in near if ident and not seed and p in active})}
            for spans, near in rows]


def spans_of(r):
    return {k: [(x["start"], x["end"]) for x in r[k]] for k in (*P.KINDS, P.FOUND)}


def check(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: spans_of(r) for r in P.extract(docs, **options).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]
    return got


PARTS = st.sampled_from(["a@b.c", "@", "x.y", ".", "1", "255", "256", "0", "+", "(", ")", "-", " ", "\n", "4111111111111111", "é", "😀",
                         "_", "1.2.3.4", "+1 (743) 555-3824", "joe", "4111 1111-1111 1111", "000"])


def test_base_equals_plain_expressions(spark):
    texts = []

    @settings(max_examples=1500, deadline=None, database=None)
    @given(st.lists(PARTS, max_size=14).map("".join))
    def collect(t):
        texts.append(t)

    collect()
    texts += ["a@b.c_x@d.e", "a@b.c.foo@bar.com", "1.2.3.4.5.6.7.8", "9" * 5000, "1 " * 3000, "+1" * 500, "a@" * 300, ".1" * 900,
              " ".join(["u1@h.de"] * 700), "00000000000000000255.1.1.1", "+" + "1" * 8, "+" + "1" * 9, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"]
    check(spark, texts)


PLANTED = ([f"please reach me at user{i}@mail.example.com today" for i in range(4)]
           + ["please reach me at agent-44718-x today", "they can reach me at agent-90210-y now",
              "or reach me at agent-33333-w soon"]
           + [f"my handle is agent-{n} here" for n in ("44718-x", "90210-y", "33333-w", "11111-z", "77777-q")]
           + ["some of the 12345 books", "one of the many, of the few, of the last",
              "sum of the 4111111111111111 and of the 10.0.0.1 or of the b@c.de"])


def test_unseen_identifiers_are_found_by_context(spark):
    got = check(spark, PLANTED * 2)
    text = PLANTED[4]
    assert [text[s:e] for s, e in got[4]["context"]] == ["agent-44718-x"]
    # the second step: known instances make a new pattern, which finds others
    assert [PLANTED[10][s:e] for s, e in got[10]["context"]] == ["agent-11111-z"]
    # "of the" comes before seeds, but also before many other words
    assert got[12]["context"] == []


def test_followers_on_both_sides_of_the_threshold(spark, monkeypatch):
    """Patterns that identifiers and words follow, in numbers on both sides of the threshold."""
    texts = list(PLANTED)
    for k in range(12):
        texts += [f"code p{chr(97 + k)}q is user{i}x{k}@mail.example.com" for i in range(6)]
        texts += [f"code is {w * 3}{chr(97 + k)}" for w in "abcdefgh"[:k]]
        texts += [f"item w{chr(97 + k)} u{i}y{k}@mail.example.com" for i in range(6)]
        texts += [f"item w{chr(97 + k)} {w * 4}" for w in "abcdefghijkl"[:k]]
        texts += [f"item w{chr(97 + k)} badge-{k}{k + 1}{k + 2}-x"]
    texts += ["ITEM Wa Straße É", "item wa É", "item\x85wa plain", "item wb", "wb item", "", "item wc  "]
    got = [check(spark, texts)]
    monkeypatch.setattr(P, "FILTER", 64)  # nearly every word passes
    got.append(check(spark, texts))
    assert got[0] == got[1]
    found = [k for k in range(12) if got[0][texts.index(f"item w{chr(97 + k)} badge-{k}{k + 1}{k + 2}-x")][P.FOUND]]
    assert found == list(range(6))  # 6000 div (7 + k) for six seeds and a badge among 7 + k followers


def test_rounds_limit_how_far_it_goes(spark):
    docs = spark.createDataFrame(list(enumerate(PLANTED)), "doc_id bigint, text string")
    one = {r["doc_id"]: r["context"] for r in P.extract(docs, rounds=1).collect()}
    assert one[4] and not one[10]


def test_query_equals_brute_force(spark):
    df = P.op11_pii(spark, SMALL)
    assert df.columns == ["doc_id", *[f"n_{k}" for k in P.KINDS], "base_sha256", "spans"]
    rows = {r["doc_id"]: r for r in df.collect()}
    docs = table(spark, SMALL, "documents").collect()
    assert len(rows) == len(docs)
    for d, want in zip(docs, brute([d["text"] for d in docs])):
        r = rows[d["doc_id"]]
        listed = [[f"{k}:{s}:{e}" for s, e in want[k]] for k in (*P.KINDS, P.FOUND)]
        assert [r[f"n_{k}"] for k in P.KINDS] == [len(x) for x in listed[:4]]
        assert r["base_sha256"] == hashlib.sha256(",".join(sum(listed[:4], [])).encode()).hexdigest()
        assert r["spans"] == ",".join(sum(listed, []))
    assert all(sum(r[f"n_{k}"] for r in rows.values()) for k in P.KINDS)


def test_no_python_runs(spark):
    df = P.extract(table(spark, SMALL, "documents"))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().toString())


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.selectExpr("*", "'x' as near", "'x' as k1", "'x' as email", "'x' as context")
    rows = P.extract(df).collect()
    assert len(rows) == 9 and all(not any(spans_of(r).values()) for r in rows)
    assert P.extract(no_docs).count() == 0
    long = "word " * 200_000 + "mail joe@example.com " + "1" * 100_000 + " " + "a" * 100_000
    twice = spark.createDataFrame([(1, long), (1, long), (None, "call +1 (743) 555-3824")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, len(r["email"]), len(r["phone"])) for r in P.extract(twice).collect()))
    assert got == [(0, 0, 1), (1, 1, 0), (1, 1, 0)]
