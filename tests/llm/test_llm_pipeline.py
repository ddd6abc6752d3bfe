"""The pipeline against a plain version of its stages, and the registered queries on the smallest sample."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from llm_data import awkward, collected, docs, jaccard_components, line_result, words_of
from test_llm_filters import plain_base
from tokenizers import Tokenizer

from eventloom.llm import mixing, queries

SAMPLE = "/root/testdata/sf0.001"
BAD = ["grimble", "foulword", "nastyterm", "vileword"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng, rows, labels = random.Random(8), [], []
    for i in range(400):
        w = words_of(500 + i, rng.randrange(20, 60), 3000)
        if i % 5 == 0:
            w[3], w[9] = rng.choice(BAD), rng.choice(BAD)
        rows.append((10_000 + i, " ".join(w), rng.choice("abc")))
        labels.append((10_000 + i, 1, int(i % 5 == 0)))
    items = [[f"b{i}w{j}" for j in range(25)] for i in range(5)]
    rows += [(20_000 + i, " ".join(words_of(i, 20, 3000) + items[i] + words_of(i + 50, 20, 3000)), "a") for i in range(5)]
    rows += awkward()
    frame = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_equals_plain_stages(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    scored = corpus_pipeline.drop_toxic(spark, frame, folder)
    assert scored.columns == frame.columns
    left = [(r.doc_id, r.text, r.source) for r in scored.collect()]
    ids = {i for i, *_ in left}
    clean = [(r.doc_id, r.text, r.source) for r in frame.collect() if not any(b in (r.text or "") for b in BAD)]
    assert sorted(left, key=repr) == sorted(clean, key=repr)
    assert not any(10_000 <= i < 10_400 and i % 5 == 0 for i in ids if i)

    lines = line_result([(i, t) for i, t, _ in left])
    left = [(i, None if t is None else kept, s) for (i, t, s), (_, kept, _, _) in zip(left, lines)]
    roots, _ = jaccard_components([(i, t) for i, t, _ in left if i is not None and i != 909], 5, 8, 10)
    left = [x for x in left if x[0] is None or roots.get(x[0], x[0]) == x[0]]
    left = [x for x in left if not any(" ".join(f"b{i}w{j}" for j in range(25)) in (x[1] or "") for i in range(5))]
    rows = docs(spark, left)
    want = Counter()
    for i, s, times in collected(mixing.copies(rows), "doc_id", "source", "copies"):
        want[i, s] = times
    mixed = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.run(spark, folder).collect()]
    assert Counter(mixed) == Counter({x: n * want[x[0], x[2]] for x, n in Counter(left).items() if want[x[0], x[2]]})


def test_every_stage_keeps_the_columns_and_takes_empty_tables(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame.limit(0), folder)
        assert out.columns == frame.columns and out.count() == 0, name


def test_queries_read_every_row(spark):
    """The queries without SQL, on the smallest sample, against plain code."""
    frame = spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()
    made = queries.queries()
    want, sizes = jaccard_components([(r.doc_id, r.text) for r in frame], 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in made["op4_ngram_join"](spark, SAMPLE).collect()}
    assert got == {i: (sizes[i], want[i]) for i in sizes}
    secrets = {r.doc_id: r.base_sha256 for r in made["op9_secrets"](spark, SAMPLE).collect()}
    assert secrets == {r.doc_id: hashlib.sha256(plain_base(r.text)[0].encode()).hexdigest() for r in frame}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r.doc_id: r.n_tokens for r in made["op6_token_counts"](spark, SAMPLE).collect()}
    assert counts == {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in frame}
    bench = spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in made["op10_decontamination"](spark, SAMPLE).collect()}
    assert found >= {(d.doc_id, b.item_id) for d in frame for b in bench if b.text in d.text}
    passages = made["op5_substring_dedup"](spark, SAMPLE).collect()
    words = {r.doc_id: r.text for r in frame}
    assert all(r.doc_id in words and r.other_id in words and r.end_word - r.start_word >= 50 for r in passages)
    copies = {}
    for r in frame:
        copies.setdefault(r.text, []).append(r.doc_id)
    reported = {r.doc_id for r in passages} | {r.other_id for r in passages}
    assert all(set(ids) <= reported for t, ids in copies.items() if len(ids) > 1 and len(t.split()) >= 60)
    scores = made["op3_toxicity"](spark, SAMPLE).collect()
    assert len(scores) == len(frame) and all(0 <= r.score <= 1 for r in scores)
    chats = made["op7_chat_format"](spark, SAMPLE).collect()
    own = spark.read.parquet(f"{SAMPLE}/conversations.parquet").collect()
    assert {r.conv_id: r.n_turns for r in chats} == Counter(r.conv_id for r in own) | {-7: 2}
