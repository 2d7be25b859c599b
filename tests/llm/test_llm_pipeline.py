import numpy as np

import corpus_pipeline as P
from batchwright.llm import bpe, decontaminate, jaccard, secrets, toxicity
from batchwright.llm.common import table
from llm_fixtures import no_docs, odd_docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark):
    """Each stage against its brute-force rule on what the stage before it kept."""
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, SMALL, "labels").where(toxicity.learn_rows()))
    scorer = toxicity.Scorer(model)
    want = {i for i, r in rows.items() if scorer.score(*scorer.read(r["text"])[:2]) < 0.5}

    docs = P.toxic_out(spark, docs, SMALL)
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want

    left = sorted(want)
    sets = [set(jaccard.shingles(rows[i]["text"]).tolist()) for i in left]
    top = list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            for b in range(a):
                if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
        if all(top[top[a]] == top[a] for a in range(len(left))):
            break
    want = {left[a] for a in range(len(left)) if top[a] == a}
    docs = P.one_of_near_copies(spark, docs, SMALL).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want

    items = [(str(r["item_id"]), decontaminate.words_of(r["text"].encode())) for r in table(spark, SMALL, "benchmark").collect()]
    clean = set()
    for i in want:
        words = decontaminate.words_of(rows[i]["text"].encode())
        n = decontaminate.brute_force(words, items)[0]
        if not (n and 20 * n >= len(words)):
            clean.add(i)
    docs = P.decontaminated(spark, docs, SMALL)
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == clean and clean < set(rows)

    docs = P.secrets_masked(spark, docs, SMALL)
    words = secrets.automaton()
    masked = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and masked == {
        i: secrets.mask(rows[i]["text"], secrets.find(rows[i]["text"], words), "[SECRET]") for i in clean}

    token = bpe.vocabulary(spark).value.token
    for r in P.tokenised(spark, docs, SMALL).collect():
        assert b"".join(token[x] for x in np.frombuffer(r["ids"], "<u4")).decode() == masked[r["doc_id"]]


def test_run(spark):
    out = P.run(spark, SMALL)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and 0 < out.count() < 200


def test_odd_rows(spark, odd_docs, no_docs):
    for docs, n in ((odd_docs.withColumn("n_chars", odd_docs["doc_id"]), 8), (no_docs, 0)):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SMALL)
        assert docs.count() == n
