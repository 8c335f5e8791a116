"""SimHash groups, collocations and ranked search against plain versions, with nulls, empty and long texts, ties and repeated rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark import Broadcast
from pyspark.sql import functions as F

from pitpanel.llm import ball_simhash, collocations, crf_quality, mask_search, sharding
from pitpanel.llm.common import Scratch

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ("node", "variant", "a", "b", "label", "rows", "is_common", "known", "p", "n", "terms", "tf", "term", "score", "rank", "task", "h", "phrase", "words", "first")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_groups(rows, radius=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def grouped(df, **kw):
    return sorted((tuple(r) for r in ball_simhash.simhash_groups(df, **kw).select("doc_id", "fingerprint", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(1 << 60, None), (7, ""), (None, " \n\t"), (8, "One"), (9, "one"), (10, "Two words"), (11, "two  words\n"), (12, "Ünï çödé 日本 語 😀 É é")]
    for i in range(20, 60):
        text = list(rng.choice(vocabulary, int(rng.integers(60, 400))))
        rows.append((i, " ".join(text)))
        for j in range(3):  # near copies
            own = list(text)
            own[int(rng.integers(len(own)))] = f"edit{j}"
            rows.append((i * 100 + j, " ".join(own)))
    rows += [rows[10], (20, "another text of the same id entirely"), (None, rows[9][1]), (None, "all alone here without any id")]
    rows.append((5, " ".join(rng.choice(vocabulary, 200_000))))  # beyond the bytes of a chunk and the shingles counted at a time
    return rows


def test_simhash_groups_equal_brute_force(spark, corpus):
    df = clashing(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3))
    want = plain_groups(corpus)
    assert grouped(df) == want
    assert len({x[2] for x in want}) < len(want) - 40
    assert grouped(df.limit(0)) == []


def test_simhash_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    centres = rng.integers(-(2**63), 2**63 - 1, 60)
    prints = {int(x) for x in centres}
    for x in centres:
        for _ in range(8):
            flipped = int(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                flipped ^= 1 << int(b) if b < 63 else -(1 << 63)
            prints.add(flipped)
    prints |= {0, -1, -(2**63), 1}
    df = spark.createDataFrame([(x,) for x in prints], "f long")
    for radius in (0, 2, 4):
        found = [tuple(r) for r in ball_simhash.links(df, radius).collect()]
        assert len(set(found)) == len(found)
        bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
        assert all(bits(a, b) <= radius for a, b in found)

        def classes(edges):
            parent = {x: x for x in prints}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in edges:
                parent[max(find(a), find(b))] = min(find(a), find(b))
            return {x: find(x) for x in prints}

        every = [(a, b) for a in prints for b in prints if a < b and bits(a, b) <= radius]
        assert classes(found) == classes(every)
    with pytest.raises(ValueError):
        ball_simhash.links(df, 3)


def test_simhash_hot_fingerprint(spark, monkeypatch):
    """A fingerprint with half the rows goes by the broadcast, the others by the join."""
    monkeypatch.setattr(ball_simhash, "COMMON", 4)
    rows = [(i, "the same short text") for i in range(300, 600)] + [(i, f"text number {i} of its own kind") for i in range(300)]
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string")) == plain_groups(rows)


def plain_phrases(rows, limit, least, longest):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    key = (lang, tuple(w[i : i + m]))
                    counts[key] = counts.get(key, 0) + 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        inside = any(
            b >= a and la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (la, q), b in found.items() if len(q) > len(p)
        )
        if not inside:
            n = total[lang]
            cuts = [(1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], n))
    ranked, place = [], Counter()
    for lang, score, a, p, left, right, n in sorted(out):
        place[lang] += 1
        if place[lang] <= limit:
            ranked.append((lang, place[lang], p.decode(), -a, left, right, n, -score))
    return ranked


def mined(df, **kw):
    return sorted(tuple(r) for r in collocations.mine_collocations(df, **kw).collect())


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(40)]
    rows = [("en", None), (None, ""), ("en", " \n.,;"), ("fr", "seul")]
    for i in range(160):
        out = []
        for _ in range(40):
            out.append(str(rng.choice(common)) if rng.random() < 0.7 else f"{rng.choice(rare)}")
            if rng.random() < 0.2:
                out.append("Kick the BUCKET at dawn, New York")
            if rng.random() < 0.1:
                out.append("an an an an an é日本!")
            if rng.random() < 0.1:
                out.append(str(rng.choice([",", "\n", "\t", "\x0b", "x.y", "a b"])))
        rows.append((["en", "de", None, "und"][i % 4], " ".join(out)))
    return rows


def test_collocations_equal_brute_force(spark, prose, monkeypatch):
    df = clashing(spark.createDataFrame(prose, "lang string, text string").repartition(3))
    for limit, least, longest, words_ in ((2000, 5, 5, 1 << 20), (7, 3, 4, 1 << 20), (1, 10, 2, 500), (25, 3, 5, 300)):
        monkeypatch.setattr(collocations, "BLOCK_WORDS", words_)
        monkeypatch.setattr(collocations, "OPEN_WORDS", 2 * words_)
        assert mined(df, limit=limit, least=least, longest=longest) == sorted(plain_phrases(prose, limit, least, longest))
    assert mined(df.limit(0)) == []


def test_collocations_stop_early(spark, monkeypatch):
    """Once the last kept score is above what frequent words can reach, they aren't expanded; ties with it still are."""
    rows = [("en", " ".join(f"pair{i} mate{i}, pair{i} mate{i}." for i in range(30)))] * 2 + [("en", "of the, of the, of the. to a. " * 200)]
    seen, expand = [], collocations._Mine.expand
    monkeypatch.setattr(collocations._Mine, "expand", lambda self, low, high: (seen.append(low), expand(self, low, high))[1])
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mined(df, limit=10, least=4) == sorted(plain_phrases(rows, 10, 4, 5))
    assert seen == [4]
    assert mined(df, limit=31, least=4) == sorted(plain_phrases(rows, 31, 4, 5))
    assert len(seen) > 2


def test_collocation_scores_pass_64_bits(spark):
    big = 10**13
    row = spark.createDataFrame([(big, 10 * big, big, 3)], "a long, n long, l long, r long")
    got = row.select(collocations._score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert got == 1000 * big * 10 * big // (big * 3)


def test_long_text_makes_blocks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 1000)
    rows = [("en", "alpha beta gamma, " * 30_000), ("en", "alpha beta, " * 50)]
    assert mined(spark.createDataFrame(rows, "lang string, text string")) == sorted(plain_phrases(rows, 2000, 100, 5))


def test_a_task_holds_few_blocks_at_once(spark, prose):
    """Blocks of a file are parted into small row groups, so what a task holds to write or read them doesn't grow with the file; each language makes one here."""
    df = spark.createDataFrame([(f"l{i}", text) for i, (_, text) in enumerate(prose)], "lang string, text string").coalesce(1)
    with Scratch(spark) as scratch:
        mine = collocations._Mine(df, 5, 5, 10, scratch)
        (file,) = (pq.ParquetFile(path.removeprefix("file://")) for path in mine.blocks.inputFiles())
        assert file.metadata.num_rows == len(prose)
        assert max(file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)) <= 4
        assert mine.langs.agg(F.sum("n")).first()[0] == sum(len(w) for w in (re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t or "") for _, t in prose))


def test_blocks_of_many_words_take_wider_codes():
    """Two bytes number the words of most blocks; beyond them four do, and the blocks read alike."""
    for distinct in (collocations.NARROW - 2, collocations.NARROW - 1, collocations.NARROW, collocations.NARROW + 1):
        text = " ".join(f"w{i}" for i in range(distinct)).encode()
        row = next(collocations._encode(iter([pa.RecordBatch.from_pydict({"lang": [b"en"], "text": [text + b", w0 w1 w1"]})])))
        block = collocations._Block(row)
        assert len(row.column("codes")[0].as_py()) == (distinct + 5) * (2 if distinct <= collocations.NARROW else 4)
        assert block.codes.tolist() == [*range(distinct), -1, 0, 1, 1, -1]
        assert block.counts().tolist() == [2, 3] + [1] * (distinct - 2)
        assert block.words[-1] == f"w{distinct - 1}".encode()


def test_a_round_leaves_no_broadcast(spark, prose, monkeypatch):
    """What a round sends out is taken back when it ends, else executors hold up to 16 MB for each of its passes until the driver collects its garbage."""
    sent, gone = [], []
    send, destroy = collocations.hash_bitmap, Broadcast.destroy
    monkeypatch.setattr(collocations, "hash_bitmap", lambda *a: (sent.append(send(*a)), sent[-1])[1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (gone.append(self), destroy(self, *a))[1])
    df = spark.createDataFrame(prose, "lang string, text string")
    assert mined(df, limit=7, least=3, longest=3) == sorted(plain_phrases(prose, 7, 3, 3))
    assert len(sent) > 4
    assert {id(x) for x in sent} == {id(x) for x in gone}


def plain_ranks(docs, items, limit):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(_LOWER))
    counted = [(doc, Counter(terms(t))) for doc, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in own if c[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scored)[:limit])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def shelf():
    rng = np.random.default_rng(9)
    vocabulary = [f"t{i}" for i in range(200)]
    weights = 1 / np.arange(1, 201)
    weights /= weights.sum()
    docs = [(1 << 60, None), (3, ""), (4, "..."), (None, "t1 t5 T9"), (None, "t1 t5 t9"), (6, "t1 t5 t9"), (5, "T1-t5/t9"), (5, "t1 t5 t9"), (7, "É日本 t3")]
    docs += [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 300)), p=weights))) for i in range(100, 500)]
    docs.append((9, " ".join(rng.choice(vocabulary, 250_000, p=weights))))  # beyond the bytes of a chunk
    items = [(1, "t1, t5. T9"), (2, None), (3, ""), (4, "unseen words"), (None, "t7 t8"), (None, "t150 t8"), (5, "t2 t3"), (5, "T3 t120"), (6, "é É日本")]
    items += [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 90))))) for i in range(10, 40)]
    return docs, items


def found(docs, items, limit):
    return sorted((tuple(r) for r in mask_search.ranked_search(docs, items, limit).collect()), key=str)


def test_search_equals_brute_force(spark, shelf, monkeypatch):
    rows, asked = shelf
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit(1) for c in ("term", "part", "doc_id")})
    assert found(docs, items, 10) == plain_ranks(rows, asked, 10)
    monkeypatch.setattr(mask_search, "PART_TERMS", 60)  # several passes
    assert found(docs, items, 3) == plain_ranks(rows, asked, 3)
    assert found(docs.limit(0), items, 10) == [] == found(docs, items.limit(0), 10)


def test_search_skips_masks_and_loses_nothing(shelf):
    """Fewer documents are evaluated than match, and the best are those of all."""
    rng = np.random.default_rng(2)
    docs, terms, length = 3000, 90, 30_000
    sizes = rng.integers(0, 20, docs)
    own = np.concatenate([np.sort(rng.choice(terms, s, replace=False)) for s in sizes]).astype(np.int32)
    tf = rng.integers(1, 4, len(own))
    n = sizes * 3
    ids, known = rng.permutation(docs).astype(np.int64), np.ones(docs, bool)
    chunk = mask_search.Chunk(ids, known, n, sizes, own, tf, docs, length)
    for item in (np.arange(5), np.arange(0, 90, 2), np.arange(90)):  # more terms than one slab of a mask has
        weights = rng.integers(1, 9000, len(item))
        best = mask_search.Best(10)
        seen = best.search(chunk, item, weights)
        weight = np.zeros(terms, np.int64)
        weight[item] = weights
        all_scores = np.zeros(docs, np.int64)
        np.add.at(all_scores, np.repeat(np.arange(docs), sizes), weight[own] * mask_search.contributions(tf, np.repeat(n, sizes), docs, length))
        order = np.lexsort((ids, -all_scores))[:10]
        assert best.id.tolist() == ids[order].tolist() and best.score.tolist() == all_scores[order].tolist()
        assert seen < (all_scores > 0).sum()
        assert mask_search.Best(10).search(chunk, item + 1000, weights) == 0


def test_search_lengths_pass_64_bits():
    tf, n, docs, terms = np.array([1, 3]), np.array([10**9, 5]), 10**11, 10**14
    want = [10**9 * int(t) // (1000 * int(t) + 8 * (10 + 90 * int(x) * docs // terms)) for t, x in zip(tf, n, strict=True)]
    assert mask_search.contributions(tf, n, docs, terms).tolist() == want


def test_one_long_text_does_not_switch_training_off(spark, monkeypatch):
    """Texts over a bound are skipped one by one: all other scores are those of a training without them."""
    from pitpanel.llm import entries

    sf = "/root/testdata/sf0.001"
    docs, labels = (entries.table(spark, sf, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    first = labels.filter(~crf_quality.held_out() & F.col("quality").isNotNull()).orderBy(F.xxhash64("doc_id")).limit(2).select("doc_id")
    ids = [r[0] for r in first.collect()]
    monkeypatch.setattr(crf_quality, "LONGEST_BYTES", 200_000)
    rest = docs.filter(~F.col("doc_id").isin(ids))
    blown = docs.withColumn("text", F.when(F.col("doc_id").isin(ids), F.repeat(F.lit("word and line\n"), 20_000)).otherwise(F.col("text")))
    scores = lambda df: {r["doc_id"]: r["score"] for r in crf_quality.quality_scores(df, labels).collect()}
    want, got = scores(rest), scores(blown)
    assert {k: got[k] for k in want} == pytest.approx(want) and len(got) == len(want) + 2
    assert len(set(want.values())) > 10
    monkeypatch.setattr(crf_quality, "TRAINING_BYTES", 30_000)  # what doesn't fit is left out, what does still trains
    assert len(set(scores(rest).values())) > 10


def test_oversized_group_without_ids_is_parted(spark):
    """Rows of one text with null ids, or all with one id, beside others: shards stay even and slots gapless."""
    for ids in (None, 7):
        rows = [(ids, "a text of many rows") for _ in range(2000)] + [(i, f"text {i} of its own") for i in range(100, 3100)]
        out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
        sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
        assert max(sizes) < 1.02 * min(sizes), sizes
        for s in range(8):
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_entry_without_the_tokenizer_package(tmp_path):
    """Only the queries that read a tokenizer need its package; everything is registered without it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('hidden', name='public_tokenizers')\n")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, 'a1_bars_legacy' in q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"})
    assert run.stdout.split()[1:] == ["True", "True"] and int(run.stdout.split()[0]) > 180, run.stderr
