"""The registered queries against their SQL, and the pipeline stage by stage."""

import glob
import os
import random
import re
from itertools import combinations

import duckdb
import pytest

import corpus_pipeline
from spanwise.llm import decontaminate, packing, queries, tokenizer, toxicity
from test_llm_operators import distance, groups_of, prose, shingles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, db, name):
    frame = queries.QUERIES[name](spark, DATA)
    names = sorted(frame.columns)
    want = db.execute(queries.ORACLES[name])
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(tuple(r) for r in frame.select(*names).collect()) == sorted(tuple(r[k] for k in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_pipeline(spark):
    """Each stage takes and keeps what its operator decides on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, DATA)
    assert clean.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, labels).collect()}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {i for i, p in scores.items() if not p}
    kept = [r["doc_id"] for r in stages["exact_dedup"](spark, docs, DATA).select("doc_id").collect()]
    rows = docs.select("doc_id", "text").collect()
    first = {}
    for i, t in sorted((r["doc_id"], " ".join(r["text"].split(" "))) for r in rows):
        first.setdefault(" ".join(t.split()), i)
    assert len(kept) == len(set(kept)) and set(first.values()) <= set(kept)
    near = [r["doc_id"] for r in stages["minhash_dedup"](spark, docs, DATA).select("doc_id").collect()]
    assert len(near) == len(set(near)) and set(near) <= {r["doc_id"] for r in rows}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = stages["decontaminate"](spark, docs, DATA).collect()
    assert not any(i in " ".join(r["text"].lower().split()) for r in left for i in items)
    out = corpus_pipeline.run(spark, DATA)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "decontaminate", "best_fit_packing"]


def test_near_dedup_stage_links_at_four_fifths(spark):
    """Near copies of a similarity between 0.8 and 0.85 go, those under 0.8 stay."""
    texts, want = [], []
    for k in range(12):
        ws = [f"w{k}x{j}" for j in range(60)]
        shared = [54, 50, 49][k % 3]  # of 56 shingles in each: 54/58, 50/62 = 0.806, 49/63 = 0.778
        texts += [" ".join(ws), " ".join([*ws[: shared + 4], *(f"v{k}x{j}" for j in range(56 - shared))])]
        want += [2 * k] if k % 3 < 2 else [2 * k, 2 * k + 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["minhash_dedup"](spark, docs, DATA)
    assert sorted(r["doc_id"] for r in left.collect()) == want


def test_pipeline_equals_brute_force(spark, tmp_path):
    """``run`` on small tables without toxic labels, row by row: which documents reach the last stage, and how they are cut."""
    rng = random.Random(31)
    rows = []
    for k in range(40):
        ws = prose(rng, 60).split()
        rows.append(" ".join(ws))
        at = [5 + 10 * x for x in range(k % 4)]
        rows.append(" ".join("new" if x in at else w for x, w in enumerate(ws)))
        if k % 5 == 0:
            rows.append("  ".join(ws))
        if k % 2:
            rows.append(" ".join(ws[: 58 - k % 8] + prose(rng, 2 + k % 8).split()))
    items = [(k, prose(rng, 15)) for k in range(6)] + [(7, "blue whale"), (8, "")]
    for k, (_, item) in enumerate(items[:7]):
        edited = item[:9] + "#" * (k % 4) + item[9 + k % 4 :]
        rows += [f"{prose(rng, 30)} {x} {prose(rng, 20)}" for x in (item.upper(), edited)]
    rows += [prose(rng, 30) + " blue whales " + prose(rng, 9), "", prose(rng, 3000)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    docs = list(zip(order, rows))
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string"),
        ("labels", [(i, 0) for i, _ in docs[::3]], "doc_id long, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    first = {}
    for i, t in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    exact = dict(first.values())
    sets = {i: shingles(t) for i, t in exact.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = groups_of(sets, links)
    near = {i: t for i, t in exact.items() if group[i] == i}

    def leaks(t):
        t = decontaminate.normalise(t)
        for _, item in items:
            item = decontaminate.normalise(item)
            if len(item) >= 24 and (item in t or len(t) < 5000 and distance(item, t) <= len(item) // 16):
                return True
            if 0 < len(item) < 24 and re.search(rf"(?<!\w){re.escape(item)}(?!\w)", t):
                return True
        return False

    want = [(i, t) for i, t in near.items() if not leaks(t)]
    assert len(docs) > len(exact) > len(near) > len(want)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = packing.pack_documents(spark.createDataFrame(want, "doc_id long, text string"), tokenizer.default_path("byte_bpe_50k.json"))
    cut = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in cut) for r in out) == sorted(tuple(r) for r in pieces.select(*cut).collect())
    assert {r["doc_id"] for r in out} == {i for i, _ in want}
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_token_counts_recounted(spark):
    """After all batches, signed and repeated ones, the totals are those of the table itself."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        encode = tokenizer.encoder(tokenizer.default_path(f"{name}.tiktoken"))
        for r in rows:
            x = want.setdefault((r["source"], r["lang"], name), [0, 0, 0])
            for k, n in enumerate((1, len(encode(r["text"] or "")), len((r["text"] or "").encode()))):
                x[k] += n
    got = queries.op1_token_counts(spark, DATA).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in got} == want
    assert spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1").count() > 0


ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "no id at all"), (None, None), (5, "long word " * 9000), (6, "one  two")]
NAMES = "item_id long, start long, score double, piece int, node long, key string, gone string, toxic int, n_lines int"


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, tmp_path, stage):
    """Nulls, empty and long texts, repeated rows, empty tables and columns of any name: what each stage does with them."""
    name, run = corpus_pipeline.STAGES[stage]
    spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "an item that is nowhere to be found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, *[None] * 9) for i, t in ODD], f"doc_id long, text string, {NAMES}")
    out = run(spark, docs, str(tmp_path))
    ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
    every = sorted((i for i, _ in ODD), key=repr)
    if name == "exact_dedup":  # an empty text goes with the null one, and one of the repeated rows with the other
        assert ids == sorted([1, 3, 4, 5, None], key=repr)
    elif name == "minhash_dedup":  # texts without words stay, rows of one id stand and fall together
        assert ids == sorted([1, 2, 3, 4, 4, 5, None, None], key=repr)
    else:
        assert sorted(set(ids), key=repr) == sorted(set(every), key=repr) and (name == "best_fit_packing" or ids == every)
    empty = run(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and (name == "best_fit_packing" or empty.columns == out.columns == docs.columns)
