"""Every operator against a plain version on a small corpus with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from pitpanel.llm import (
    backoff_lm, crf_quality, decontaminate, html_content, near_dedup, packing, sharding, substring_dedup, token_counts, weak_rules,
)

BASE = "the quick brown fox jumps over the lazy dog while nine small cats watch from a tall green fence in the warm sun".split()
PASSAGE = [f"passage{i}" for i in range(60)]


def _texts():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    out = {0: " ".join(BASE), 1: " ".join(BASE), 2: " ".join([*BASE[:-1], "rain"]), 3: None, 4: "", 5: " \n\t ", 6: "One", 7: "one", 8: "A b", 9: "a  B"}
    for i in range(10, 40):
        own = list(rng.choice(words, 80))
        if i % 5 == 0:
            own[20:20] = PASSAGE
        out[i] = "\n".join(" ".join(own[k : k + 12]) for k in range(0, len(own), 12))
    for i in range(40, 50):  # near copies of 10
        own = out[10].split(" ")
        own[int(rng.integers(0, len(own)))] = f"edit{i}"
        out[i] = " ".join(own)
    out[50] = "For " * 200
    out[51] = "\n".join(["same line here again and again"] * 20)
    out[52] = " ".join(f"{w}***" for w in rng.choice(words, 60))
    out[53] = " ".join(rng.choice(words, 9000))  # long
    out[54] = "Ünï çödé 日本語 テスト 😀 end"
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in _texts().items()] + [(None, "no id " * 20, "en", "s", 1), (11, _texts()[11], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, clashing).repartition(3)
    for name in ("counts", "votes", "posterior", "_counts", "_votes", "_kept", "hits", "_hits", "_n_hit", "bucket", "bits", "may_be", "own_id", "own_low", "known", "out", "judged_id"):
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    df = df.withColumn("big", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + (1 << 60) + 1))
    return df.withColumn("n_words", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("block", F.lit("x")).withColumn("size", F.lit(0))


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, " ".join(PASSAGE[:20]).upper()), (2, "quick brown"), (3, None), (None, "the lazy dog"), (4, ""), (5, "absent words here"), (2, "quick brown")]
    return spark.createDataFrame(items, "item_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collect(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=str)


def test_sharding(docs, rows):
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == len(rows)
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len((t or "").encode()) + 1) for i, t, *_ in rows)


def test_placement_equals_the_plain_rule():
    rng = np.random.default_rng(6)
    for n, shards in ((0, 3), (1, 3), (40, 3), (120, 8)):
        vectors = rng.integers(1, 9, (n, 3)) ** 2.0
        vectors /= np.maximum(vectors.sum(axis=0), 1)
        room, want = [[1 / shards] * 3 for _ in range(shards)], [0] * n
        for i in sorted(range(n), key=lambda i: (-max(vectors[i]), i)):
            v = vectors[i]
            fits = [s for s in range(shards) if all(room[s][d] >= v[d] - 1e-12 for d in range(3))]
            if fits:
                best = max(fits, key=lambda s: (round(sum(room[s][d] * v[d] for d in range(3)), 15), -s))
            else:
                best = max(range(shards), key=lambda s: (round(min(room[s][d] - v[d] for d in range(3)), 15), -s))
            room[best] = [room[best][d] - v[d] for d in range(3)]
            want[i] = best
        placed = sharding.place(vectors, shards)
        agree = [int(p) for p in placed] == want
        sums = lambda p: np.array([vectors[np.array(p) == s].sum(axis=0) for s in range(shards)])
        assert agree or np.allclose(np.sort(sums(placed), axis=0), np.sort(sums(want), axis=0), atol=0.02)
        even = sharding.even_out(vectors, placed, shards)
        spread = lambda p: (sharding.WEIGHTS * (sums(p) - 1 / shards) ** 2).sum() if n else 0
        assert spread(even) <= spread(placed) and len(even) == n
        if n > 100:  # all three dimensions
            assert np.abs(sums(even) * shards - 1).max() < 0.03


def test_sharding_keeps_equal_texts_together(spark):
    """A text with 8 % of the rows fits into a shard and stays whole; one with a third can't and is cut."""
    rows = [(i, "hot") for i in range(3000)] + [(i, "warm text") for i in range(3000, 3720)]
    rows += [(i, f"text {i // 2} " * (i % 7 + 1)) for i in range(3720, 9000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    where, text = {}, dict(rows)
    for r in out:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(where.pop("hot")) > 1 and all(len(s) == 1 for s in where.values())
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.02 * min(size.values())


def test_sharding_balances_many_documents(spark):
    many = [(i, "x" * (1 + i * 37 % 200)) for i in range(5000)] + [(i, "hot text") for i in range(5000, 7500)]
    out = sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string"), 8).collect()
    size, count = Counter(), Counter()
    for r in out:
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    assert max(size.values()) < 1.02 * min(size.values())
    assert max(count.values()) < 1.1 * min(count.values())


def test_token_counts(docs, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = collect(token_counts.count_tokens(docs, path, 50), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 50) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    odd = ["  a   b    ccc", "\n\n  x\t y", "日本語 テスト", "<s> </s><unk>", "▁▁a ▁b", " " * 37 + "the" + " " * 5, "x" * 300, "f(x):\n    return  x+1\n"]
    counter = token_counts.PrefixCounter(path)
    for text, counts in zip(odd, counter.prefix_counts(odd), strict=True):
        assert counts.tolist() == [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        cut = token_counts.within_budget(counts, 3)
        assert len(model.encode(text[:cut])) <= 3


def _contamination(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        n = min(13, len(p))
        wins = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in wins and item is not None:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(docs, rows, benchmark, monkeypatch):
    items = [tuple(r) for r in benchmark.collect()]
    want = sorted(((i, *_contamination(t, items)) for i, t, *_ in rows), key=str)
    kept = sorted((i for i, _, _, _, _, bad in want if not bad), key=str)
    for part, lane in ((decontaminate.MAX_PART_BYTES, 512), (30, 7)):  # one set of tables, and several one after the other
        monkeypatch.setattr(decontaminate, "LANE", lane)
        monkeypatch.setattr(decontaminate, "MAX_PART_BYTES", part)
        out = decontaminate.contamination(docs, benchmark)
        out = out.withColumn("sha", decontaminate.items_digest(out["items"]))
        assert collect(out, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == want
        for r in out.collect():
            spans = [(s["start"], s["end"]) for s in r["spans"]]
            assert spans == sorted(spans) and sum(b - a for a, b in spans) == r["n_hit"]
        clean = decontaminate.drop_contaminated(docs, benchmark)
        assert clean.columns == docs.columns and [i for (i,) in collect(clean, "doc_id")] == kept
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_wu_manber_equals_brute_force():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 40))))) for i in range(40)] + [(1, "w1 w2"), (2, "w1 w2"), (3, "w5")]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(50)] + ["", " ".join(rng.choice(vocabulary, 3000))]
    for text, (n, spans, found) in zip(texts, decontaminate.Tables(items, 3).find([t.encode() for t in texts]), strict=True):
        w, hit, want = text.split(), set(), set()
        for item, t in items:
            p = t.split()
            m = min(3, len(p))
            wins = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k : k + m]) in wins:
                    hit.update(range(k, k + m))
                    want.add(item)
        assert n == len(w) and found == sorted(want)
        assert {k for s in spans for k in range(s["start"], s["end"])} == hit


def test_tables_of_a_large_benchmark_stay_small():
    """Of 4 MB of text: 9 MB of tables for each MB, built within 60 MB for each MB."""
    import pickle
    import tracemalloc

    rng = np.random.default_rng(1)
    words_ = [f"word{i}" for i in range(30_000)]
    items = [(i, " ".join(rng.choice(words_, 300))) for i in range(1400)]
    megabytes = sum(len(t) for _, t in items) / 1e6
    tracemalloc.start()
    tables = decontaminate.Tables(items)
    assert tracemalloc.get_traced_memory()[1] / 1e6 < 60 * megabytes
    tracemalloc.stop()
    assert len(pickle.dumps(tables)) / 1e6 < 10 * megabytes


def test_lm_scores(docs, rows):
    toks = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] for _, t, *_ in rows]
    for order in (1, 2, 3, 4):
        counts = [Counter(tuple(t[k : k + n]) for t in toks for k in range(len(t) - n + 1)) for n in range(1, order + 1)]
        total = sum(map(len, toks))
        want = []
        for (i, *_), t in zip(rows, toks, strict=True):
            score = 0.0
            for k in range(len(t)):
                penalty = 0.0
                for n in range(min(order, k + 1), 0, -1):
                    gram = tuple(t[k - n + 1 : k + 1])
                    if n == 1:
                        score += penalty + np.log(counts[0][gram] / total)
                    elif counts[n - 1][gram] >= 2:
                        score += penalty + np.log(counts[n - 1][gram] / counts[n - 2][gram[:-1]])
                        break
                    else:
                        penalty += np.log(0.4)
            want.append((i, len(t), round(score, 5)))
        got = [(i, n, round(s, 5)) for i, n, s in collect(backoff_lm.score_documents(docs, order), "doc_id", "n_words", "log_score")]
        assert sorted(got, key=str) == sorted(want, key=str)


def _dedup(rows):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12) if i is not None else ():
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def test_substring_dedup(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "block_count", lambda n: 5)
    assert collect(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == _dedup(rows)
    monkeypatch.setattr(substring_dedup, "SLICE_CELLS", 300)  # several slices
    assert collect(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == _dedup(rows)
    monkeypatch.setattr(substring_dedup, "PART_CELLS", 70)  # and each counted in parts
    assert collect(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == _dedup(rows)
    monkeypatch.setattr(substring_dedup, "MAX_SLICES", 2)  # a crowded sketch loses nothing
    assert collect(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == _dedup(rows)


def test_substring_dedup_parts_of_common_windows(spark, docs, rows, monkeypatch):
    """Groups of one window are parted by block, whatever the number of parts; a window of every block makes no group of all blocks."""
    monkeypatch.setattr(substring_dedup, "block_count", lambda n: 7)
    for blocks in (1, 3):
        monkeypatch.setattr(substring_dedup, "GROUP_BLOCKS", blocks)
        assert collect(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == _dedup(rows)
    monkeypatch.setattr(substring_dedup, "GROUP_BLOCKS", 100)
    sent = spark.range(4000).selectExpr("id % 2 as low", "0L as high", "(id * 37) % 4001 as doc_id", "shiftleft(id, 32) + id % 5 as place")
    later = substring_dedup._sent_earlier(sent, 4000)
    first = {low: min((i * 37) % 4001 for i in range(low, 4000, 2)) for low in (0, 1)}
    want = sorted((i, i % 5) for i in range(4000) if first[i % 2] < (i * 37) % 4001)
    assert sorted((r["block"], r["place"] & 0xFFFFFFFF) for r in later.collect()) == want


def test_rice_codes_round_trip():
    rng = np.random.default_rng(0)
    for n, width in ((1, 1), (1, 5), (3, 100), (5000, 40_000_000), (700, 70_000), (500, 600)):
        cells = np.unique(rng.integers(0, width, n)).astype(np.uint32)
        assert (substring_dedup.unpack(substring_dedup.pack(cells)) == cells).all()


def test_substring_dedup_keeps_columns_and_untouched_texts(docs, rows):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.drop("text", "n_chars").exceptAll(docs.drop("text", "n_chars")).count() == 0
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, n, removed, kept in _dedup(rows):
        if removed == 0:
            assert text[i] == next(t for j, t, *_ in rows if j == i)
        else:
            assert words(text[i]) == words(kept)


def test_quality_rules(docs, rows):
    want = []
    for i, t, *_ in rows:
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    out = weak_rules.quality_verdicts(docs)
    assert collect(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=str)
    assert out.filter("kept and base_failed").count() == 0
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not kept[50] and not kept[3] and not kept[52]
    good = weak_rules.keep_good(docs)
    assert good.columns == docs.columns and good.exceptAll(docs).count() == 0
    assert collect(good, "doc_id") == collect(out.filter("kept"), "doc_id")


def test_quality_rules_run_python_once_for_each_pass(docs):
    plan = weak_rules.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_estimate_equals_brute_force():
    """EM over patterns against EM over single documents, and rates found again that made the votes."""
    rng = np.random.default_rng(4)
    truth, votes = rng.random(4000) < 0.9, []
    for y in truth:
        objects = rng.random(5) < ([0.02, 0.05, 0.01, 0.15, 0.02] if y else [0.9, 0.8, 0.7, 0.6, 0.85])
        votes.append("".join("-" if rng.random() < 0.2 else "0" if o else "1" for o in objects))
    patterns = sorted(set(votes))
    good, rate, share = weak_rules.estimate(patterns, np.array([votes.count(p) for p in patterns], float))
    posterior = np.array([0.1 if "0" in v else 0.9 for v in votes])
    for _ in range(60):
        own = (posterior.sum() + 1) / (len(votes) + 2)
        table = np.ones((2, 5))
        for y, w in ((1, posterior), (0, 1 - posterior)):
            for k in range(5):
                against, for_ = (sum(x for x, v in zip(w, votes, strict=True) if v[k] == c) for c in "01")
                against, for_ = against + weak_rules.PRIOR[y][0], for_ + weak_rules.PRIOR[y][1]
                table[y, k] = against / (against + for_)
        for i, v in enumerate(votes):
            p = [1 - own, own]
            for y in (0, 1):
                for k, c in enumerate(v):
                    p[y] *= {"0": table[y, k], "1": 1 - table[y, k], "-": 1}[c]
            posterior[i] = p[1] / sum(p)
    assert np.allclose([good[patterns.index(v)] for v in votes], posterior, atol=1e-4)
    assert abs(share - 0.9) < 0.02 and np.abs(rate - [[0.9, 0.8, 0.7, 0.6, 0.85], [0.02, 0.05, 0.01, 0.15, 0.02]]).max() < 0.06
    # an objection of the rule that is often wrong doesn't reject a document that the others approve of
    assert good[patterns.index("11101")] > 0.5 and good[patterns.index("00000")] < 0.01


def test_quality_rules_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = weak_rules.quality_verdicts(spark.read.parquet(f"{d}/documents.parquet")).filter("not base_failed")
    known = out.join(labels, "doc_id")
    assert known.filter("quality = 1 and not kept").count() <= 0.02 * known.filter("quality = 1").count()
    assert known.filter("quality = 0 and kept").count() <= 0.1 * known.filter("quality = 0").count()
    # the verdict isn't that of all rules at once
    assert out.filter("kept and votes like '%0%'").count() > 0


def _groups(rows, width, percent=80):
    sets = []
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if i is not None else None) for k, ((i, *_), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, rows, width):
    out = near_dedup.near_groups(docs, width=width)
    assert collect(out, "doc_id", "n_shingles", "component_id") == _groups(rows, width)


def test_near_dedup_chains_need_the_rest(spark, monkeypatch):
    """A chain where only neighbours are linked, all in the same buckets: stars alone can't connect it."""
    chain = [(i, " ".join(f"t{k}" for k in range(i * 4, i * 4 + 60))) for i in range(24)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert collect(near_dedup.near_groups(df), "doc_id", "n_shingles", "component_id") == _groups(chain, 2)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    assert collect(near_dedup.near_groups(df), "doc_id", "n_shingles", "component_id") == _groups(chain, 2)


def test_near_dedup_of_common_classes(spark, monkeypatch):
    """Half of the rows wordless, a third copies of one text: both are labelled apart from the join of the rest."""
    texts = ["" if k % 2 else " ".join(BASE) if k % 3 == 0 else f"own text of number {k % 50}" for k in range(400)]
    rows = [(k if k % 17 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (4, near_dedup.COMMON):
        monkeypatch.setattr(near_dedup, "COMMON", common)
        assert collect(near_dedup.near_groups(df), "doc_id", "n_shingles", "component_id") == _groups(rows, 2)


def test_rest_cuts_buckets_of_long_sets(spark, monkeypatch):
    """Blocks are bounded by shingles too, and still every pair is compared once."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 5_000)
    sets = [[k * 10_000 + j for j in range(1_000)] for k in range(20)] + [[j for j in range(50, 1_000)]]
    node = "struct<id:bigint,low:bigint>"
    df = spark.createDataFrame([((k, 0), s, (k, 0)) for k, s in enumerate(sets)], f"node {node}, set array<long>, label {node}")
    live = df.selectExpr("1 as band", "2L as hash", "node", "size(set) as n", "label", "21L as size", "false as centre")
    out = near_dedup._rest(live, df.select("node", "set"), 80)
    assert out.filter("pairs is not null").count() > 1  # several pairs of blocks
    assert out.agg({"pairs": "sum"}).first()[0] == 21 * 20 // 2
    assert [(r["a"]["id"], r["b"]["id"]) for r in near_dedup._named(out).collect()] == [(0, 20)]


def test_similar_sets_equal_brute_force():
    rng = np.random.default_rng(8)
    make = lambda k: [np.unique(rng.integers(0, 40, int(rng.integers(1, 30)))).astype(np.int64) * 7919 for _ in range(k)]
    ours, theirs = make(30), make(20)
    got = near_dedup._similar(ours, theirs, 60)
    for a, x in enumerate(ours):
        for b, y in enumerate(theirs):
            both = len(set(x) & set(y))
            assert got[a, b] == (100 * both >= 60 * (len(x) + len(y) - both))


def test_sketches_rule_out_no_link():
    """Bits that differ never outnumber the shingles that differ."""
    rng = np.random.default_rng(11)
    for n in (1, 5, 300, 4000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64)
            y = np.concatenate([x[: len(x) - len(x) // 5], rng.integers(0, 1 << 62, int(rng.integers(0, n + 1))).astype(np.uint64)])
            differ = int(np.bitwise_count(near_dedup.sketch_of(x).view(np.uint64) ^ near_dedup.sketch_of(y).view(np.uint64)).sum())
            assert differ <= len(set(x.tolist()) ^ set(y.tolist()))


def test_rest_compares_each_pair_once(spark, monkeypatch):
    """Fifty members of one bucket, ten alike by twos: every pair is compared in one task, once, and pairs of one label never."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    sets = [[k * 100 + j for j in range(20)] for k in range(45)] + [[k * 100 + j for j in range(1, 20)] for k in range(5)]
    node = "struct<id:bigint,low:bigint>"
    df = spark.createDataFrame([((k, 0), s, (k, 0)) for k, s in enumerate(sets)], f"node {node}, set array<long>, label {node}")
    live = df.selectExpr("1 as band", "2L as hash", "node", "size(set) as n", "label", "50L as size", "false as centre")
    out = near_dedup._rest(live, df.select("node", "set"), 80)
    assert out.agg({"pairs": "sum"}).first()[0] == 50 * 49 // 2
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in near_dedup._named(out).collect()) == [(k, 45 + k) for k in range(5)]


def test_one_of_each(docs, rows):
    out = near_dedup.one_of_each(docs, width=5)
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] for r in out.filter("doc_id is not null").collect())
    assert ids == sorted({i for i, _, c in _groups(rows, 5) if i is not None and i == c})
    assert out.filter("doc_id is null").count() == 1


def test_densification_fills_every_bin():
    sig = near_dedup.signature(np.array([5, 9], dtype=np.uint64), 160)
    assert len(set(sig.tolist())) <= 2 and np.iinfo(np.uint64).max not in sig


@pytest.mark.parametrize("cell", [10, 20_000])
def test_packing(docs, rows, cell):
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = packing.pack_documents(docs, ranks, pattern, (64, 128, 256), cell).collect()
    pieces = Counter()
    for r in out:
        pieces[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(packing._encoding(ranks, pattern).encode_ordinary(t or ""))
    assert pieces == want
    bins = {}
    for r in out:
        bins.setdefault((r["cell"], r["bin"]), []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["position"])
        at = 0
        for r in held:
            assert r["offset"] == at
            at += r["n_tokens"]
        assert held[0]["capacity"] == min(c for c in (64, 128, 256) if c >= at)


def _packed_slowly(lengths, capacities):
    """The rule of `pack` word for word: every open bin and every capacity looked at for each piece."""
    open_, where = [], []
    for i, n in enumerate(lengths):
        fits = [b for b in open_ if b["size"] - b["used"] >= n]
        if fits:
            tight = min(b["size"] - b["used"] for b in fits)
            chosen = max((b for b in fits if b["size"] - b["used"] == tight), key=lambda b: b["time"])
        else:
            cost = {}
            for c in capacities:
                if c >= n:
                    cost[c] = packing.sequence_cost(c) / max(1, n + min(c - n, sum(x for x in lengths[i + 1 :] if x <= c - n)))
            chosen = {"size": min(cost, key=lambda c: (cost[c], c)), "used": 0, "nth": len(open_)}
            open_.append(chosen)
        where.append((chosen["nth"], chosen["used"]))
        chosen["used"] += n
        chosen["time"] = i
    return where, [min(c for c in capacities if c >= b["used"]) for b in open_]


def test_packing_equals_the_plain_rule():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 300):
        lengths = sorted(rng.integers(0, 100, n).tolist(), reverse=True)
        bins, offsets, final = packing.pack(lengths, (16, 32, 64, 100))
        assert (list(zip(bins, offsets, strict=True)), final) == _packed_slowly(lengths, (16, 32, 64, 100))


def test_packing_costs_little_more_than_the_best():
    """All ways to pack a few pieces: the greedy rule's total cost stays close to the least."""

    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]

    rng = np.random.default_rng(2)
    capacities = (512, 1024, 2048, 4096)
    for _ in range(12):
        lengths = sorted(rng.integers(50, 3000, 7).tolist(), reverse=True)
        cost = lambda sizes: sum(packing.sequence_cost(min(c for c in capacities if c >= s)) for s in sizes)
        least = min(cost([sum(b) for b in p]) for p in partitions(lengths) if all(sum(b) <= 4096 for b in p))
        assert sum(map(packing.sequence_cost, packing.pack(lengths, capacities)[2])) <= 1.25 * least


def test_packing_fills_bins_and_opens_several_capacities():
    rng = np.random.default_rng(1)
    lengths = sorted(np.minimum(4096, rng.lognormal(6, 1, 5000)).astype(int).tolist(), reverse=True)
    bins, _, final = packing.pack(lengths, packing.CAPACITIES)
    assert len(final) == max(bins) + 1 and set(final) == set(packing.CAPACITIES)
    assert sum(lengths) / sum(final) > 0.95


def test_wide_ids_beside_null_ids(spark, benchmark):
    """Ids beyond 2 ** 53 and a null in one group stay what they are, and the smaller of two copies keeps its text."""
    import public_tokenizers

    text = " ".join(PASSAGE)
    df = spark.createDataFrame([((1 << 60) + 3, text), (None, text), ((1 << 60) + 1, text)], "doc_id long, text string").coalesce(1)
    ids = sorted(df.collect(), key=str)
    model, ranks = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        sharding.shard_documents(df), crf_quality.quality_scores(df, labels), packing.pack_documents(df, ranks, public_tokenizers.PATTERN), token_counts.count_tokens(df, model),
        decontaminate.contamination(df, benchmark), backoff_lm.score_documents(df), substring_dedup.remove_repeats(df), weak_rules.quality_verdicts(df), near_dedup.near_groups(df),
    ):
        assert collect(out, "doc_id") == sorted(((r["doc_id"],) for r in ids), key=str)
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    assert removed == {(1 << 60) + 1: 0, (1 << 60) + 3: 60, None: 0}
    assert collect(near_dedup.one_of_each(df), "doc_id") == [((1 << 60) + 1,), (None,)]


def test_split_by_ids(spark, monkeypatch):
    from pitpanel.llm import common

    rows = spark.range(1000).selectExpr("if(id = 7, null, id) as key", "id as bucket")
    ids = rows.filter("key % 10 = 3").select("key")
    for most in (1 << 27, 1 << 15):
        monkeypatch.setattr(common, "MAX_BITS", most)
        may, sure = common.split_by_ids(rows, rows["key"], ids, 100)
        assert may.columns == rows.columns and may.count() + sure.count() == 1000
        assert sure.filter("key % 10 = 3").count() == 0 and sure.filter("key is null").count() == 1 and may.count() < 200


def test_crf(spark, docs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = crf_quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95
    odd = crf_quality.quality_scores(docs, labels.limit(0)).toPandas()
    assert odd["score"].between(0, 1).all() and len(odd) == docs.count()


def test_crf_marginals_equal_brute_force():
    rng = np.random.default_rng(3)
    chain = crf_quality.Chain(1)
    chain.moves = rng.normal(size=(2, 2))
    emissions = rng.normal(size=7)
    starts, lengths = np.array([0, 4]), np.array([4, 3])
    good, _ = chain.marginals(emissions, starts, lengths)
    for s, n in zip(starts, lengths, strict=True):
        weight = np.zeros((n, 2))
        for path in np.ndindex(*[2] * n):
            p = np.exp(sum(emissions[s + k] * path[k] for k in range(n)) + sum(chain.moves[path[k], path[k + 1]] for k in range(n - 1)))
            for k in range(n):
                weight[k, path[k]] += p
        assert np.allclose(good[s : s + n], weight[:, 1] / weight.sum(axis=1))


def test_tree_marginals_equal_brute_force():
    page = "<div><p>one</p><ul><li>two<li>three</ul></div>"
    nodes, runs = html_content.parse(page)
    rows = html_content.features(nodes, runs)
    rng = np.random.default_rng(5)
    model = html_content.TreeModel(rng.normal(size=(rows.shape[1], 3)), rng.normal(size=(3, 3)))
    score = rows @ model.weights
    weight = np.zeros((len(nodes), 3))
    for states in np.ndindex(*[3] * len(nodes)):
        p = np.exp(sum(score[k, states[k]] for k in range(len(nodes))) + sum(model.pair[states[n.parent], states[n.index]] for n in nodes[1:]))
        for k, state in enumerate(states):
            weight[k, state] += p
    assert np.allclose(model.states(nodes, rows), weight / weight.sum(axis=1, keepdims=True))


def test_tree_model_on_held_out_labelled_pages():
    rng, right, every, model = np.random.default_rng(99), np.zeros(2), np.zeros(2), html_content.trained_model()
    for _ in range(80):
        bare, known = html_content.given_labels(html_content.labelled_page(rng))
        nodes, runs = html_content.parse(bare)
        content = model.marginals(nodes, html_content.features(nodes, runs)) >= 0.5
        for is_content, label in zip(content, known, strict=True):
            every[int(label == html_content.CONTENT)] += 1
            right[int(label == html_content.CONTENT)] += is_content == (label == html_content.CONTENT)
    assert (right / every > 0.95).all()


_STORY = "The river rose in the night, and by morning the lower road was gone. People came out to look at it. "
_BODY = f"<h1>Flood</h1><p>{_STORY * 3}</p><p>{_STORY * 2}Last.</p>"
_HOME = '<nav><a href="/">Home</a><a href="/n">News</a></nav>'
_TALK = "<div><b>Ann</b><p>I was there that day. It was bad.</p></div><div><b>Bob</b><p>So was I, and my brother too.</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout no-sidebar">{_HOME}<article>{_BODY}</article><footer>Foot 2020</footer></div>',
        f'<form id="aspnetForm"><header><a href="/">Home</a></header><div id="x1">{_BODY}</div><footer>Foot 2020</footer></form>',
        f'<form id="main">{_HOME}<article>{_BODY}</article></form>',
        f"{_HOME}<article>{_BODY.replace('<h1>Flood</h1>', '<header><h1>Flood</h1></header>')}</article><footer>Foot 2020</footer>",
        f'{_HOME}<article>{_BODY}<section class="discussion"><h2>Discussion</h2>{_TALK}</section></article><footer>Foot 2020</footer>',
        f'<article>{_BODY}<section class="zz9"><h2>Talk</h2>{_TALK}</section></article>',
    ],
)
def test_wrappers_headers_and_comments(page):
    """Misleading names and tags neither lose the article nor let in what readers say."""
    got = html_content.main_text(f"<html><body>{page}</body></html>", html_content.trained_model())
    assert got == f"Flood\n\n{(_STORY * 3).strip()}\n\n{_STORY * 2}Last."


def test_html_extraction(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(900, "u", None), (901, "u", ""), (902, None, "<p>bare & <b>bold"), (903, "u", "<<<>>> &#0; <div")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_content.extract(pages.unionByName(odd)).collect()}
    assert out[900]["text"] == out[901]["text"] == "" and len(out) == pages.count() + 4
    for r in pages.collect():
        article = re.sub(r"</?b>|<br>", " ", r["html"].split("<article>")[1].split("</article>")[0])
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?p>|</?h1>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert out[r["page_id"]]["text"] == want and out[r["page_id"]]["n_chars"] == len(want)


def test_hidden_is_read_from_attributes_only():
    story = "The river rose in the night, and by morning the lower road was gone. "
    shown = ['class="overflow-hidden"', 'class=hidden-xs', 'id="hidden-gems"', 'title="The hidden river"', "data-a='display:none'", 'style="overflow:hidden"']
    gone = ["hidden", 'class="a" hidden=""', 'aria-hidden="true"', 'style="color:red; display : none"', "STYLE='display:none'"]
    model = html_content.trained_model()
    for attributes in [*shown, *gone]:
        assert html_content.parse(f"<p {attributes}>{story}</p>")[0][1].hidden == (attributes in gone), attributes
        page = f'<html><body><nav><a href="/">Home</a></nav><article><p>{story}</p><p {attributes}>Second. {story}</p></article></body></html>'
        assert ("Second." in html_content.main_text(page, model)) == (attributes in shown), attributes
        page = f'<html><body><div {attributes}><article><h1>Flood</h1><p>{story * 2}</p></article></div><footer>Foot</footer></body></html>'
        assert (story.strip() in html_content.main_text(page, model)) or attributes in gone, attributes
    page = f'<html><body><article><h1>Flood</h1><p>{story * 3}<a href="/a/hidden/b">The bridge.</a></p></article></body></html>'
    assert html_content.main_text(page, model) == "Flood\n\n" + story * 3 + "The bridge."


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){{ // don{}t\n}}</script>", "<style>/* a<b don{}t */</style>", "<title>i<n don{}t</title>"])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_raw_elements_end_at_their_end_tag(raw, quote):
    story = "The river rose in the night, and by morning the lower road was gone. "
    model = html_content.trained_model()
    own = raw.format(quote)
    for tail in ("", " It's late."):
        page = f"<html><head>{own}</head><body><article><h1>Flood</h1>{own}<p>{story * 3}</p><p>{story}Last.{tail}</p></article></body></html>"
        assert html_content.main_text(page, model) == f"Flood\n\n{(story * 3).strip()}\n\n{story}Last.{tail}"


def test_empty_tables(spark, docs, benchmark):
    import public_tokenizers

    none = docs.limit(0)
    model = public_tokenizers.path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    outs = [
        sharding.shard_documents(none), crf_quality.quality_scores(none, labels), packing.pack_documents(none, public_tokenizers.path('byte_bpe_50k.tiktoken'), public_tokenizers.PATTERN), token_counts.count_tokens(none, model),
        decontaminate.contamination(none, benchmark), backoff_lm.score_documents(none), substring_dedup.remove_repeats(none), weak_rules.quality_verdicts(none),
        near_dedup.near_groups(none), html_content.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    for out in outs:
        assert out.count() == 0


def test_only_null_texts(spark, benchmark):
    none = spark.createDataFrame([(1, None), (2, None), (None, None)], "doc_id long, text string")
    assert near_dedup.near_groups(none).filter("kept").count() == 3
    assert substring_dedup.remove_repeats(none).filter("n_words = 0").count() == 3
    assert backoff_lm.score_documents(none).filter("log_score = 0").count() == 3
    assert sharding.shard_documents(none).count() == 3
    assert weak_rules.quality_verdicts(none).filter("not kept").count() == 3


def test_one_id_with_several_texts(spark):
    df = spark.createDataFrame([(1, " ".join(BASE)), (1, "something else entirely, not like it"), (2, "something else entirely, not like it"), (0, " ".join(BASE))], "doc_id long, text string")
    out = near_dedup.near_groups(df).collect()
    assert len(out) == 4 and {r["component_id"] for r in out} == {0}


@pytest.mark.parametrize("stars", [0, 2])
def test_near_links_through_both_texts_of_one_id(spark, monkeypatch, stars):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", stars)
    texts = [[f"{lane}{k}" for k in range(60)] for lane in "abc"]
    a, b, c = (" ".join(t) for t in texts)
    near_a, near_b, near_c = (" ".join([*t[:-1], "edit"]) for t in texts)
    rows = [(1, a), (1, b), (1, a), (1, ""), (2, near_a), (2, c), (3, near_b), (4, near_c), (5, "apart " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = collect(near_dedup.near_groups(df), "doc_id", "component_id", "kept")
    assert out == sorted(((i, 5 if i == 5 else 1, i in (1, 5)) for i, _ in rows), key=str)
    one = collect(near_dedup.one_of_each(df), "doc_id", "text")
    assert one == sorted([(1, a), (1, b), (1, ""), (2, c), (5, "apart " * 20)], key=str)


def test_hashes_tell_windows_apart():
    from pitpanel.llm.common import inside, window_hashes, word_codes, word_hashes

    flat = [b"a", b"b", b"a", b"c", b"a", b"b"]
    h = window_hashes(word_hashes(*word_codes(flat)), 2)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert inside(np.array([3, 1, 2]), 2).tolist() == [0, 1, 4]


_FLOOD = "The river rose in the night, and by the morning it was over the road. People left their houses."
_PLAIN = {
    "text straight in the body": (f"<body>{_FLOOD}</body>", [_FLOOD]),
    "text without any element": (_FLOOD, [_FLOOD]),
    "one paragraph": (f"<p>{_FLOOD}</p>", [_FLOOD]),
    "a list of links": (
        "<body><nav><a href=/>Home</a><a href=/n>News</a></nav><article><h1>Ten rivers</h1><ul>" + "".join(f"<li><a href=/{i}>The river {i} of the list</a></li>" for i in range(10)) + "</ul></article></body>",
        ["Ten rivers", *[f"The river {i} of the list" for i in range(10)]],
    ),
    "an apostrophe in an unquoted value": (f"<article><h1>Flood</h1><p title=it's>{_FLOOD}</p><p>{_FLOOD}</p></article>", ["Flood", _FLOOD, _FLOOD]),
    "CDATA that isn't closed": (f"<article><h1>Flood</h1><![CDATA[ x <b><p>{_FLOOD}</p><p>{_FLOOD}</p></article>", ["Flood", _FLOOD, _FLOOD]),
    "a formula": (f"<article><h1>Flood</h1><p>{_FLOOD}</p><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here, so it goes on.</p></article>", ["Flood", _FLOOD, "We have x=2 here, so it goes on."]),
    "a button in a sentence": (f"<article><h1>Flood</h1><p>{_FLOOD}</p><p>Press the <button>Start</button> key, and wait for the water.</p></article>", ["Flood", _FLOOD, "Press the Start key, and wait for the water."]),
    "a newsletter at the end": (f"<article><h1>Flood</h1><p>{_FLOOD} {_FLOOD}</p><p>{_FLOOD}</p><aside><p>Subscribe to our newsletter for more news every week.</p></aside></article>", ["Flood", f"{_FLOOD} {_FLOOD}", _FLOOD]),
}


@pytest.mark.parametrize("name", _PLAIN)
def test_plain_and_odd_pages_keep_their_text(name):
    page, blocks = _PLAIN[name]
    assert html_content.main_text(page, html_content.trained_model()) == "\n\n".join(blocks)
