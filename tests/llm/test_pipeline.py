"""The pipeline's stages against brute force, one by one on what the stage before kept."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from weft.llm import mixing, quality, secrets
from weft.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return [table(spark, SF, "documents"), *out]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + cp.WIDTH]) for i in range(max(1, len(words) - cp.WIDTH + 1))}


def test_columns_and_stage_names(stages):
    assert len(cp.STAGES) == 5 and len({n for n, _ in cp.STAGES}) == 5
    assert all(d.columns == stages[0].columns for d in stages[1:-1]) and "ids" in stages[-1].columns


def test_quality_stage_keeps_trusted_documents(spark, stages):
    kept, labels = rows(stages[1]), table(spark, SF, "labels").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2
    verdicts = quality.classify(stages[0], table(spark, SF, "labels")).where("accepted").collect()
    assert {r.doc_id for r in verdicts} == set(kept)


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, kept = rows(stages[1]), rows(stages[2])
    label, sets, where = {d: d for d in before}, {d: shingles(r.text) for d, r in before.items()}, collections.defaultdict(list)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for d in sorted(sets):
        for s in sets[d]:
            where[s].append(d)
    shared = collections.Counter((v[i], v[j]) for v in where.values() for i in range(len(v)) for j in range(i + 1, len(v)))
    for (a, b), n in shared.items():
        if n / len(sets[a] | sets[b]) >= cp.SIMILARITY:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    assert set(kept) == {d for d in before if find(d) == d}
    assert all(kept[d] == before[d] for d in kept)


def test_secret_stage_masks_and_keeps(stages):
    before, after = rows(stages[2]), rows(stages[3])
    token = re.compile(r'(token = ")[0-9a-f]{40}(")')
    assert any(token.search(r.text) for r in before.values())
    assert {d: r.text for d, r in after.items()} == {d: token.sub(rf"\1{secrets.MASK}\2", r.text) for d, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixing_stage_applies_the_draw(spark, stages):
    drawn = mixing.mix(stages[3], mixing.topics_of(table(spark, SF, "embeddings"))).where("selected").collect()
    assert {r.doc_id for r in drawn} == set(rows(stages[4])) and 0 < len(drawn) < stages[3].count()


def test_encoding_stage_round_trips(stages):
    texts = rows(stages[4])
    encoded = rows(stages[5])
    assert set(encoded) == set(texts) and all(r.round_trip and len(r.ids) == r.n_ids for r in encoded.values())


def test_odd_documents_pass_every_stage(spark):
    schema = table(spark, SF, "documents").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (3, "x" * 70000, "de", "s", 70000), (3, "x" * 70000, "de", "s", 70000)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= len(data)


def row(i, text, source="s"):
    return (i, text, "en", source, len(text))


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    data = [row(1, a), row(5, a), row(5, b), row(7, c), row(7, c), row(None, c), row(None, "lone words here"), row(None, "lone words here"), row(9, "")]
    data += [(10, None, "en", "s", None)]
    docs = spark.createDataFrame(data, table(spark, SF, "documents").schema).withColumn("mark", F.lit(1)).withColumn("label", F.lit("x"))
    out = cp.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", a), ("5", b), ("7", c), ("None", "lone words here"), ("9", "")])


def test_mixing_keeps_the_drawn_row_of_an_id(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", F.explode(F.array(F.lit("p"), F.when(F.col("doc_id") % 3 == 0, F.lit("q")))).alias("source"), "n_chars")
    drawn = mixing.mix(docs, mixing.topics_of(table(spark, SF, "embeddings"))).where("selected").collect()
    out = cp.mix_sources(spark, docs, SF).collect()
    key = lambda r: (r.doc_id, r.source or mixing.NONE)
    assert sorted(map(key, out)) == sorted(map(key, drawn)) and len({r.doc_id for r in out}) < len(out)


def test_borderline_clusters_lose_no_link(spark):
    rng = random.Random(41)
    data = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(12):
            words = base[:]
            for at in rng.sample(range(150), rng.choice([0, 1, 2, 3])):
                words[at] = f"x{rng.randrange(10**6)}"
            data.append(row(len(data), " ".join(words)))
    docs = spark.createDataFrame(data, table(spark, SF, "documents").schema)
    sets = [shingles(r[1]) for r in data]
    label = list(range(len(data)))
    for at in range(0, len(data), 12):
        for _ in range(12):
            for i in range(at, at + 12):
                for j in range(at, i):
                    if len(sets[i] & sets[j]) >= cp.SIMILARITY * len(sets[i] | sets[j]):
                        label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()} == set(label)


CLASHING = "k fp h mark tile held_out score selected topic label start row text_ matches found secrets of_id of_text of_cell rejected_key __weft_id __weft_m __weft_k draw part n".split()


@pytest.mark.parametrize("stage", range(4))
def test_columns_of_any_name(spark, sf_small, stage):
    """Helper columns take names that the table does not have; every other column goes through as it was."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    more = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    got = cp.STAGES[stage][1](spark, more, sf_small)
    assert got.columns == more.columns
    plain = cp.STAGES[stage][1](spark, docs, sf_small)
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)
