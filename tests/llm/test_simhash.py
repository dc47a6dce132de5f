"""SimHash near-duplicates against all pairs in plain Python."""

import random

import xxhash
from pyspark.sql import functions as F

from weft.llm import simhash


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (format(f, "016x"), label[i]) for i, f in fps}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_matches_all_pairs_on_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs)) == brute(rows)


def test_chains_empty_null_and_repeated_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(i, " ".join(base[:800] + base[800 : 800 + i])) for i in range(12)]
    rows += [(100, ""), (101, None), (102, " \t\n "), (103, "One"), (104, "one"), (105, "two words"), (106, "İx É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("tile", F.lit("x"))
    assert result(simhash.near_duplicates(docs)) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "zz y x w")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("3", "3"), ("None", "3"), ("None", "None")]


def test_blocks_of_one_tile_all_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "MEET", 2)
    rng = random.Random(7)
    base = rng.getrandbits(64)
    values = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 9) for b in range(0, 64, 7)} | {rng.getrandbits(64) for _ in range(40)}
    fps = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    from weft.operators.graph import components

    labels = {bytes(r.node): bytes(r.label) for r in components(simhash.links(fps, 3)).collect()}
    got = {}
    for v in values:
        k = v.to_bytes(8, "big")
        got.setdefault(labels.get(k, k), set()).add(v)
    parts = []
    for v in values:
        touching = [p for p in parts if any((v ^ x).bit_count() <= 3 for x in p)]
        parts = [p for p in parts if p not in touching] + [{v}.union(*touching)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts))


def test_fine_tiles_give_the_same_components(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = result(simhash.near_duplicates(docs))
    monkeypatch.setattr(simhash, "CROWDED", 10)
    monkeypatch.setattr(simhash, "BROADCAST_TILES", 10)
    assert result(simhash.near_duplicates(docs)) == want


def test_exact_similarity_check(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near, far = words[:], words[:]
    near[150] = "other"
    for at in range(0, 300, 12):
        far[at] = f"x{at}"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words))], "doc_id long, text string")
    out = result(simhash.near_duplicates(docs, width=5, radius=56, words=4, min_jaccard=0.8))
    assert [out[i][1] for i in (1, 2, 3, 4)] == [1, 1, 3, 1]


def brute_similar(rows, width, radius, words, least):
    """Components by all pairs of shingle sets, fingerprints of the sets."""
    sets = {i: set(simhash.shingle_hashes(t or "", width)) for i, t in rows}
    fps = {i: int.from_bytes(simhash.fingerprint(sorted(x), words), "big") for i, x in sets.items()}
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])
    linked = [(i, j) for i in sets for j in sets if i < j and near(i, j)]
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_repeated_blocks_count_once(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, line = text(100), text(150), text(80), text(12)
    rows = [(1, a), (2, " ".join([a] * 3)), (3, " ".join([a] * 9)), (4, b), (5, f"{b} {line} {line}"), (6, " ".join([b] + [line] * 20)), (7, c), (8, " ".join(["x"] * 400)), (9, " ".join(["x"] * 9)), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: c for i, (_, c) in result(simhash.near_duplicates(docs, 5, 52, 4, 0.8)).items()}
    assert got == brute_similar(rows, 5, 52, 4, 0.8)
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[6] == 4 and got[8] == got[9] == 8


def test_failed_links_stand_for_no_others(spark):
    rng = random.Random(23)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(8):
            words = base[:]
            for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_similar(rows, 5, 80, 4, 0.8)
    assert {i: c for i, (_, c) in result(simhash.near_duplicates(docs, 5, 80, 4, 0.8)).items()} == want


def test_failed_links_are_judged_in_one_pass(spark, monkeypatch):
    rng = random.Random(31)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(None, None), (900, ""), (901, " "), (902, "one"), (902, "one")]
    for k in range(60):
        words = base[:]
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(70, rows[9][1]), (70, rows[9][1])]
    asked, real = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: asked.append(1) or real(edges))
    monkeypatch.setattr(simhash, "BLOCK", 16)  # several blocks of one tile
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_similar([r for r in rows if r[0] is not None], 5, 80, 4, 0.8)
    results = []
    for few, all_at_once in ((simhash.FEW, simhash.ASKED), (0, 0)):
        monkeypatch.setattr(simhash, "FEW", few)
        monkeypatch.setattr(simhash, "ASKED", all_at_once)
        results.append({i: c for i, (_, c) in result(simhash.near_duplicates(docs, 5, 80, 4, 0.8)).items() if i is not None})
    assert results == [want, want]
    assert len(asked) == 2  # links that fail lead to no further rounds
