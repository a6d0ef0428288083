"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellweave.llm import (
    common,
    cotrain_quality,
    lbl_lm,
    mcd_rules,
    pivotal_mix,
    site_template,
    sorted_projection,
    suffix_merge_dedup,
    suffix_sentencepiece,
    tensor_minhash,
    token_range_coder,
)
from cellweave.llm.common import Stages, components
from cellweave.llm.textkernel import Words

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string, unit long, h long"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(70)
    texts = [base, base, base.replace(" ", "\n", 5), base + " " + say(3), say(60) + "\n" + passage + "\n" + say(50), passage + " " + say(90), None, "", " \n\t ", "One", "one", "Two words", "x" * 900, "ab " * 400, say(6000), "日本 語 x " * 20]
    texts += [say(rng.randint(1, 200)) for _ in range(30)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 7 % 3], None if t is None else len(t), "x", "y", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[4], rows[0], (None, base, None, "a", 3, "x", "y", 1, 2), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall(text or "")


def test_words_are_those_of_the_pattern(rows):
    texts = [(r[1] or "").encode() for r in rows]
    w = Words(texts)
    for i, r in enumerate(rows):
        assert w.bounds[i + 1] - w.bounds[i] == len(words(r[1]))
    same = collections.defaultdict(set)
    for h, a, b in zip(w.hash.tolist(), w.start, w.end, strict=True):
        same[h].add(bytes(w.buf[a:b]).decode().translate(LOWER))
    assert all(len(s) == 1 for s in same.values())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 70), (70, 50), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(Stages(spark, "test"), links).collect()}
    assert got == {i: 1 for i in range(2, 31)} | {60: 50, 70: 50}


def test_components_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 40)
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(50)]
    got = {r.id: r.component for r in components(Stages(spark, "test"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    u, v = common.contract(*np.array([p for p in pairs if p[0] != p[1]], np.int64).T)
    assert got == dict(zip(u.tolist(), v.tolist(), strict=True)) and got[60] == 0


# 1


def test_range_coder_round_trips():
    rng = np.random.default_rng(1)
    for n, k, block in ((0, 1, 64), (1, 5, 64), (63, 9, 64), (64, 9, 64), (65, 40000, 64), (5000, 50257, 256), (20000, 30, 4096), (4097, 2, 4096)):
        ids = rng.integers(0, k, n)
        parts = token_range_coder.compress(ids, block)
        assert (token_range_coder.expand(parts, n, block) == ids).all()
    repeated = np.tile(rng.integers(0, 50257, 500), 8)
    assert sum(map(len, token_range_coder.compress(repeated))) < len(repeated)  # under a byte an id, where plain ids take two


def test_damage_is_found():
    data = bytearray(token_range_coder.pack([1, None], [300, 200], np.arange(500) % 77))
    names, sizes, ids = token_range_coder.unpack(bytes(data))
    assert names == [1, None] and sizes.tolist() == [300, 200] and (ids == np.arange(500) % 77).all()
    data[-3] ^= 1
    with pytest.raises(ValueError):
        token_range_coder.unpack(bytes(data))


def test_ids_are_the_tokenizers(spark, docs, none, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_range_coder.default_tokenizer())
    got = token_range_coder.read_ids(token_range_coder.write_ids(docs, segment=500)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    start, want = 0, []
    for r in sorted(rows, key=key):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_range_coder.read_ids(token_range_coder.write_ids(none)).count() == 0
    token_range_coder.write_ids(docs, to=str(tmp_path / "ids"))
    assert sorted((tuple(r) for r in token_range_coder.read_ids(spark.read.parquet(str(tmp_path / "ids"))).collect()), key=lambda r: r[1]) == want


def test_executors_code_as_the_format_says_and_faster(spark):
    java, rng = token_range_coder.coder(spark), np.random.default_rng(2)
    for n, k in ((1, 1), (700, 9), (4096, 65536), (4096, 2), (4000, 40)):
        ids = rng.integers(0, k, n)
        part = token_range_coder.compress(ids)[0]
        raw = ids.astype("<u2").tobytes()
        assert bytes(java.compressBlock(raw)) == part and bytes(java.expandBlock(part, n)) == raw
    ids = (rng.pareto(0.7, 1 << 19) * 50).astype(np.int64) % 50257
    raw, took = ids.astype("<u2").tobytes(), []
    for _ in range(3):
        began = time.perf_counter()
        assert bytes(java.expandBlock(java.compressBlock(raw), len(ids))) == raw
        took.append(time.perf_counter() - began)
    began = time.perf_counter()
    assert (token_range_coder.expand(token_range_coder.compress(ids), len(ids)) == ids).all()
    assert 3 * min(took) < time.perf_counter() - began


def test_pieces_give_the_ids_of_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(token_range_coder.default_tokenizer()), random.Random(5)
    alphabet = ["a", "Zq", "the", "é", "ß", "×", "÷", "ñ", "ª", "Ж", "日", "\u0301", "'", "'s", "'ll", "'re", "1", "42", "²", ".", ",", "(", "|", "<", ">", "_", "-", " ", " ", "  ", "\n", "\t", "\x0b", "\u00a0", "\u0085", "\u3000", "\x00", "\x7f", "🙂", "<|endoftext|>", "endoftext", "<|"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["don't, I'll", "x" * 3000 + "," * 3000, " <|endoftext|> a", "a<|endoftext|>b, c", None, ""]
    files = token_range_coder.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), segment=9000, to=str(tmp_path / "ids"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    got = {}
    for r in files.collect():
        names, sizes, ids = token_range_coder.unpack(bytes(r.data))
        got |= {i: ids[e - n : e].tolist() for i, n, e in zip(names, sizes, np.cumsum(sizes), strict=True)}
    assert got == want
    crc = {r.doc_id: r.ids_crc32 for r in token_range_coder.read_ids(files).collect()}
    assert crc == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}
    r = files.first()
    damaged = bytearray(r.data)
    damaged[-3] ^= 1
    with pytest.raises(Exception, match="is damaged"):
        token_range_coder.read_ids(spark.createDataFrame([(r.part, r.seq, r.start, r.ids, damaged)], files.schema)).collect()


# 2


def test_classifier_learns_and_scores_all(spark, docs, none):
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(400)]
    make = lambda bad: " ".join(rng.choice(vocabulary) + ("***" if bad == 1 else "") for _ in range(60)) + (" stupid scum" if bad == 2 else "")
    made = [(i, make(i % 5 % 3), "en", "a", 100) for i in range(500)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 % 3 != 1), int(i % 5 % 3 == 2)) for i in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotrain_quality.score(table, labels, rounds=1).collect()}
    held_out = [i for i in range(1, 500, 2)]
    right = sum(got[i].kept == (i % 5 % 3 == 0) for i in held_out)
    assert len(got) == 500 and right >= 0.97 * len(held_out)
    assert all(0 <= x <= 1 for r in got.values() for x in (r.text_score, r.meta_score, r.score))
    assert cotrain_quality.score(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert cotrain_quality.score(none, labels).count() == 0
    kept = cotrain_quality.keep_good(table, labels, rounds=0)
    assert kept.columns == table.columns and 0 < kept.count() < 500


def test_rows_that_share_an_id_are_judged_each(spark):
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(400)]
    make = lambda bad: " ".join(rng.choice(vocabulary) + "***" * bad for _ in range(60))
    made = [(i, make(i % 2), "en", "a", 100) for i in range(300)]
    twins = [(i, make(bad), lang, source, 100) for i in (1000, None) for bad in (0, 1) for lang, source in (("en", "a"), (None, "a"), ("a", None))]
    table = spark.createDataFrame(made + twins + twins[:1], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    score = cotrain_quality.score(table, labels, rounds=0)
    kept = collections.Counter((r.doc_id, "***" in r.text) for r in cotrain_quality.keep_good(table, labels, rounds=0).where("doc_id is null or doc_id = 1000").collect())
    assert score.columns == ["doc_id", "text_score", "meta_score", "score", "kept"]
    assert kept == {(1000, False): 4, (None, False): 3}


@pytest.mark.parametrize(("good", "kept"), [(1, 300), (0, 0)])
def test_labels_of_one_class(spark, good, kept):
    table = spark.createDataFrame([(i, f"word{i} and more", "en", "a", 20) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, good, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    score = cotrain_quality.score(table, labels, rounds=1)
    assert score.where("kept").count() == kept and score.where(f"abs(score - {(201 if good else 1) / 202}) > 1e-9").count() == 0


def test_labels_of_odd_rows(spark, docs, rows):
    """Labels of null and very long texts, of repeated and of null doc_ids, null labels, and clashing columns."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in ids] + [(ids[0], None, 1, "y"), (ids[1], 1, 1, "y"), (None, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    first, again = ([tuple(r) for r in cotrain_quality.score(d, labels, rounds=1).orderBy("doc_id", "score").collect()] for d in (docs, docs.repartition(5)))
    assert len(first) == len(rows) and all(r[3] is not None and 0 <= r[3] <= 1 for r in first)
    assert all(a[0] == b[0] and a[3] == pytest.approx(b[3], abs=1e-9) for a, b in zip(first, again, strict=True))


def test_metadata_is_told_apart_to_its_end():
    a, b = cotrain_quality.meta_features(["en"] * 2, ["x" * 200 + "1", "x" * 200 + "2"], [5, 5])
    assert a[1] != b[1] and a[2] != b[2] and a[0] == b[0]


# 3


def base_statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in mcd_rules.SYMBOLS for x in w for c in x), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(docs, none, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in mcd_rules.judge(docs).collect())
    want = collections.Counter()
    for r in rows:
        s = base_statistics(r[1])
        want[(r[0], *s, s[0] < 20 or 100 * s[4] > 30 * s[0])] += 1
    assert got == want
    assert mcd_rules.judge(none).count() == 0


def test_rules_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(5)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 400)))) for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice("abc") + "***$$$" for _ in range(100 + i))) for i in range(20)]
    table = spark.createDataFrame([(*x, "en", "s") for x in clean + junk], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in mcd_rules.judge(table).collect()}
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk)
    x = np.array([[math.log1p(s[0]), math.log1p(s[1] / s[0]), math.log1p(10 * s[2] / s[1]), math.log1p(4 * s[4] / s[0] + s[3] / s[0])] for s in (base_statistics(t) for _, t in clean + junk)])
    d = np.array([got[i].distance for i, _ in clean + junk])
    inner = x[d <= mcd_rules.REWEIGHT]  # the estimate is a fixed point of the reweighted step, but for rows at its border
    cov = np.cov(inner.T, bias=True)
    np.fill_diagonal(cov, np.maximum(np.diag(cov), np.array(mcd_rules.FLOOR) ** 2))
    mine = np.einsum("ij,jk,ik->i", x - inner.mean(axis=0), np.linalg.inv(cov), x - inner.mean(axis=0))
    assert np.corrcoef(mine, d)[0, 1] > 0.99


def fast_mcd(x, starts):
    """Least determinant over concentration steps from random halves, independent of the operator; the distances."""
    rng, best = np.random.default_rng(0), None

    def floored(rows, scale=1.0):
        cov = scale * np.cov(rows.T, bias=True)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), np.array(mcd_rules.FLOOR) ** 2))
        return rows.mean(axis=0), cov

    def far(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    for _ in range(starts):
        mean, cov = floored(x[rng.permutation(len(x))[: len(x) // 3]])
        for _ in range(20):
            d = far(mean, cov)
            mean, cov = floored(x[d <= np.quantile(d, mcd_rules.ALPHA)], mcd_rules.CONSISTENT)
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), mean, cov
    inner = x[far(best[1], best[2]) <= mcd_rules.REWEIGHT]
    return far(*floored(inner))


def test_rules_find_the_least_determinant_of_each_cell(spark):
    rng = random.Random(8)
    make = lambda lo, hi, n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(lo, hi))) for _ in range(n))
    rows = []
    for k, (lo, hi) in enumerate(((2, 5), (7, 11))):  # what is usual in one source is odd in the other
        rows += [(1000 * k + i, make(lo, hi, rng.randint(40, 300)), "en", "ab"[k]) for i in range(60)]
        rows += [(1000 * k + 500 + i, make(25, 40, rng.randint(40, 300)), "en", "ab"[k]) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in mcd_rules.judge(table).collect()}
    again = {r.doc_id: r.distance for r in mcd_rules.judge(table.repartition(5)).collect()}
    assert {i: r.distance for i, r in got.items()} == again
    for k in (0, 1):
        own = [r for r in rows if r[0] // 1000 == k]
        s = [base_statistics(r[1]) for r in own]
        x = np.array([[math.log1p(a[0]), math.log1p(a[1] / a[0]), math.log1p(10 * a[2] / a[1]), math.log1p(4 * a[4] / a[0] + a[3] / a[0])] for a in s])
        want = fast_mcd(x, 30)
        mine = np.array([got[r[0]].distance for r in own])
        assert np.allclose(mine, want, rtol=0.05, atol=0.05)
        assert all(got[r[0]].kept == (r[0] % 1000 < 500) for r in own)


# 4


def jaccard_classes(rows, width, percent):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(docs, rows, width, percent):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in tensor_minhash.near_duplicates(docs, width, percent).collect())
    assert got == collections.Counter((*x, x[0] == x[2]) for x in jaccard_classes(rows, width, percent))


def test_a_group_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(tensor_minhash, "HEADS", 2)  # several rounds
    monkeypatch.setattr(tensor_minhash, "WIDER", 3)
    rng = random.Random(21)
    vocabulary = ["w%d" % i for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(160):  # without their original; some link, some are too far from all others
        w = list(base)
        for at in rng.sample(range(150), rng.randint(1, 9)):
            w[at] = rng.choice(vocabulary[:12])
        rows.append((i, " ".join(w), "x"))
    table = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in tensor_minhash.near_duplicates(table, 3, 85).collect())
    want = jaccard_classes(rows, 3, 85)
    assert got == collections.Counter(want) and 20 < len({c for _, _, c in want}) < 150


def test_buckets_of_a_loose_group_take_few_rows(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(200)]
    rows = []
    for k in range(160):  # each shares about 0.7 with the first, 0.5 with the others
        words = list(base)
        for at in rng.sample(range(200), 12):
            words[at] = f"x{k}.{at}"
        rows.append((k, " ".join(words)))
    seen = []

    class Counting(Stages):
        def save(self, df, name="t"):
            out = super().save(df, name)
            if name == "live":
                seen.append(out.count())
            return out

    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in tensor_minhash.near_duplicates(table, 3, 85, Counting(spark, "counting")).collect())
    assert got == collections.Counter(jaccard_classes(rows, 3, 85))
    assert seen[0] > 160 and max(seen) <= tensor_minhash.SIDE * len(rows)


def test_one_document_of_a_group_stays(docs, none, rows):
    kept = tensor_minhash.deduplicate(docs, width=3, percent=85)
    assert kept.columns == docs.columns
    want = {(d, r[1]) for r, (d, _, c) in zip(rows, jaccard_classes(rows, 3, 85), strict=True) if d == c}
    assert sorted(((r.doc_id, r.text) for r in kept.where("text is not null").collect()), key=str) == sorted((x for x in want if x[1] is not None), key=str)
    assert tensor_minhash.near_duplicates(none).count() == 0


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    say = lambda k: " ".join("w%d" % (i * k) for i in range(60))
    near = say(1) + " more"
    rows = [(None, say(1), 1), (None, near, 1), (7, say(5), 1), (7, say(5) + " more", 1), (8, say(9), 1), (8, say(9), 2), (None, "", 1), (None, " ", 1)]
    kept = tensor_minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, h int"), width=3, percent=85).collect()
    groups_ = [sum(r.doc_id == i and (r.text or "").startswith(t) for r in kept) for i, t in ((None, say(1)), (7, say(5)), (8, say(9)))]
    assert groups_ == [1, 1, 1] and sum(not r.text.strip() for r in kept) == 2 and len(kept) == 5


# 5


def test_mix(docs, none, rows):
    got = pivotal_mix.mix_report(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, (5, 2, 1), strict=False))
    goal, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        stop = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not stop:
            goal |= share
            break
        for s in stop:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        open_ -= stop
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    targets = {round(r.target, 6) for r in got}
    assert targets == {round(g, 6) for g in goal.values()}
    again = pivotal_mix.mix_report(docs.repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    mixed = pivotal_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert pivotal_mix.mix_report(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    table = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 60)), "abcd"[min(rng.randint(0, 6), 3)]) for i in range(3000)], "doc_id long, text string, source string")
    rows = pivotal_mix.mix_report(table).join(table.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 61 for r in rows)


# 6


def test_language_model(docs, none, rows, monkeypatch):
    monkeypatch.setattr(lbl_lm, "HEAD", 60)  # most words come by the join
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lbl_lm.score(docs).collect())
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [[*words((r[1] or "").translate(LOWER)), None] for r in rows]
    c = collections.Counter(t for r, ts in zip(rows, tokens, strict=True) if not out(r[0]) for t in ts)
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r, ts in zip(rows, tokens, strict=True):
        want[(r[0], out(r[0]), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6))] += 1
    assert got == want
    assert lbl_lm.score(none).count() == 0


def test_language_model_is_normalised_and_learns(monkeypatch):
    monkeypatch.setattr(lbl_lm, "SPREAD", 7.6)  # 64 classes of 64 words
    rng = np.random.default_rng(4)
    counts = np.sort(rng.integers(1, 500, 5000))[::-1]
    v = lbl_lm.Vocabulary.of(rng.integers(2, 2**62, 5000).astype(np.uint64), counts, int(counts.sum()), 5000)
    m = lbl_lm.Model(v)
    m.A[:] = rng.standard_normal(m.A.shape) * 0.2
    m.Q[:] = rng.standard_normal(m.Q.shape) * 0.2
    everything = np.arange(v.known + 1)
    one = np.full(len(everything), 7)
    assert np.exp(m.log_prob(one, one + 1, everything, m.tables())).sum() == pytest.approx(1, abs=1e-4)
    rest = counts[v.known :]
    assert ((rest + 0.1).sum() + 0.1) / v.rest_norm == pytest.approx(1)
    m = lbl_lm.Model(v)
    chain = np.zeros(60000, np.int64)  # each word names the next
    for i in range(1, len(chain)):
        chain[i] = (chain[i - 1] * 7 + rng.integers(0, 3)) % 500
    w, w1, w2 = chain[2:], chain[1:-1], chain[:-2]
    before = m.log_prob(w1, w2, w, m.tables()).mean()
    t = lbl_lm.Trainer(m)
    for _ in range(5):
        for i in range(0, len(w), 4096):
            t.step(w1[i : i + 4096], w2[i : i + 4096], w[i : i + 4096])
    assert m.log_prob(w1, w2, w, m.tables()).mean() > before + 1


def test_language_model_beats_its_base_alike_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(lbl_lm, "SHARD", 30_000)
    rng = random.Random(12)
    tongues = [["%s%d" % (t, i) for i in range(80)] for t in "abc"]
    texts = [" ".join(rng.choice(tongues[k % 3]) for _ in range(rng.randint(50, 400))) for k in range(900)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lbl_lm.score(table.repartition(2)).collect()}
    out = [r for r in got.values() if r.held_out]
    per_token = lambda name: sum(r[name] for r in out) / sum(r.n_tokens for r in out)
    assert per_token("score") > per_token("base_score") + 0.3  # a language is told by two words: log10(3) = 0.48 at most
    again = {r.doc_id: r.score for r in lbl_lm.score(table.repartition(7)).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-6) for i, r in got.items())


def test_a_tokens_score_is_the_same_in_any_batch():
    rng = np.random.default_rng(4)
    v = lbl_lm.Vocabulary.of(np.arange(4000, dtype=np.uint64), rng.integers(1, 900, 4000), 2_000_000, 4000)
    m = lbl_lm.Model(v)
    m.A, m.Q = (rng.standard_normal(x.shape).astype(np.float32) for x in (m.A, m.Q))
    w1, w2, w = rng.integers(0, 2 * v.known, 5000), rng.integers(0, 2 * v.known, 5000), rng.integers(0, v.known + 1, 5000)
    tables = m.tables()
    whole = m.log_prob(w1, w2, w, tables)
    for size in (1, 7, 33, 1000):
        at = slice(40, 40 + 3 * size)
        some = [m.log_prob(w1[i : i + size], w2[i : i + size], w[i : i + size], tables) for i in range(40, 40 + 3 * size, size)]
        assert np.abs(np.concatenate(some) - whole[at]).max() < 1e-8


@pytest.mark.parametrize("head", [2, 100])
def test_language_model_has_a_head_at_any_level(docs, monkeypatch, head):
    monkeypatch.setattr(lbl_lm, "HEAD", head)
    _, v = lbl_lm.learn_vocabulary(docs.select(F.lit(False).alias("held_out"), "text"), Stages(docs.sparkSession, "test"))
    assert lbl_lm.END in v.hashes and 1 <= len(v.hashes) <= 2 * head + 20


# 7

PAGES = [
    ("", ""),
    ("<p>a", "a"),
    ("text < 5 &amp; <b>x</b><p>q<script>if(a<b)'</p>'</script>z", "text < 5 & x\nqz"),
    ("<nav>n</nav><article><h1>T</h1><p>One<br>two&nbsp; three<p><b>four<p>five</article><footer>f</footer>", "T\nOne two three\nfour\nfive"),
    ("<main><header><h1>T</h1></header><div><p>One</p><aside>no</aside><ul><li>i<li>j</ul></div><section id=comments><article>a much longer comment of a reader</article></section></main>", "T\nOne\ni\nj"),
    ("<article><p>x</p><div class='cookie-notice'>c</div><form>f</form><p>y</p></article>", "x\ny"),
    ("<article><p>a</p><div hidden>b</div><div class=related>c</div></article><div>no</div><article>d</article>", "a\nb\nc\nd"),
    ("<nav><article>n</article></nav><main><p>m</p></main>", "m"),
]


def test_pages_by_structure():
    for html, want in PAGES:
        assert "\n".join(t for t, _ in site_template.main_blocks(html)[0]) == want


def test_long_and_deep_pages():
    n = 30_000
    for html in ("<div>a" * n, "<div>a<b>" * n + "</i>" * n, "<article>" + "<p>a</p>" * n + "</article>", "<ul><li>a" * n + "</ul>" * n):
        blocks, trees, seen, _ = site_template.main_blocks(html)
        assert [t for t, _ in blocks] == ["a"] * n and all(up < k for k, (_, up) in enumerate(trees))
    assert site_template.main_blocks("<" * n)[0] and site_template.main_blocks("&amp" * n)[0] == [("&" * n, -1)]


def test_pages_of_template_alone_have_no_text(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><p>The same</p></div><div><p>Number {i}</p></div>") for i in range(6)] + [(9, "http://h.example/9", "<div><p>The same</p></div>")]
    got = {r.page_id: r.text for r in site_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Number {i}" for i in range(6)} | {9: ""}


def test_recurring_subtrees_go(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=top>Menu of the site</div><div><p>Text number {i}</p></div><div>Bottom line</div>") for i in range(8)]
    rows += [(20, "http://other.example/1", "<div>Menu of the site</div><p>Alone</p>"), (21, None, None), (20, "http://other.example/1", "<div>Menu of the site</div><p>Alone</p>")]
    rows += [(30 + i, f"http://copy.example/{i}", "<article><div><p>the same article</p></div></article>") for i in range(8)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in site_template.main_text(pages).collect())
    want = [(i, f"Text number {i}", 13) for i in range(8)] + [(20, "Menu of the site\nAlone", 22)] * 2 + [(21, "", 0)] + [(30 + i, "the same article", 16) for i in range(8)]
    assert got == want
    assert site_template.main_text(pages.limit(0)).count() == 0


def test_recurring_subtrees_go_on_large_hosts(spark):
    part = lambda i: "<div><p>Notice of the section</p></div>" if i < 6 else "<div><p>Twice told</p></div>" if i < 10 else ""
    rows = [(i, f"http://h.example/{i}", f"<article><p>Text number {i}</p></article>") for i in range(700)]
    rows += [(1000 + i, f"http://h.example/x{i}", f"<div><p>Page number {i}</p></div>{part(i)}") for i in range(10)]
    got = {r.page_id: r.text for r in site_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[1000 + i] for i in range(6)] == [f"Page number {i}" for i in range(6)]  # 6 of 710 pages are less than one in a hundred
    assert [got[1000 + i] for i in range(6, 10)] == [f"Page number {i}\nTwice told" for i in range(6, 10)]


# 8


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.1 * rng.standard_normal(16)).tolist(), int(i % 12 % 3)) for i in range(150)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] + [1.0] * 15, 1), (204, rows[3][1], None), (205, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0), (208, [], 0), (None, rows[5][1], rows[5][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cls string")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in sorted_projection.near_duplicates(table, window=8).collect())
    unit = []
    for _, v, lab in rows:
        ok = lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = collections.Counter((r[0], links[i], least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows))
    assert got == want
    assert sorted_projection.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [7, 64, 200])
def test_vectors_across_many_tasks(spark, parts):
    rng = np.random.default_rng(8)
    size = 120  # distinct vectors of a label: one pass, whose window takes in the whole label
    centres = rng.standard_normal((size // 2, 16))
    rows = [(i, (centres[i % (size // 2)] + 0.05 * rng.standard_normal(16)).tolist(), i // size) for i in range(3 * size)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.vec_id: r.n_links for r in sorted_projection.near_duplicates(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted_projection.passes_for(size, 0.93) == 1 and link.any()
    assert got == {i: int(n) for i, n in enumerate(link.sum(axis=1))}


def test_passes_follow_the_size():
    assert sorted_projection.passes_for(100, 0.93) == 1
    assert sorted_projection.passes_for(10_000, 0.93) < sorted_projection.passes_for(1_000_000, 0.93)


def test_recall_in_a_dense_cloud(spark, tmp_path):
    rng = np.random.default_rng(14)
    n, dim, planted = 50_000, 64, 400
    axis = rng.standard_normal(dim)
    axis /= np.linalg.norm(axis)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(0.75) * axis + 0.5 * x  # cosines of 0.75 on average
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((planted, dim))
    y -= (y * x[:planted]).sum(axis=1, keepdims=True) * x[:planted]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.935 * x[:planted] + np.sqrt(1 - 0.935**2) * y
    x = np.concatenate([x, y])
    links = set()
    for lo in range(0, len(x), 1000):
        i, j = np.nonzero(x[lo : lo + 1000] @ x.T >= 0.93)
        links |= {(a, b) for a, b in zip((i + lo).tolist(), j.tolist(), strict=True) if a < b}
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.ones(len(x), np.int32)}), tmp_path / "cloud.parquet")
    got = sorted_projection.near_duplicates(spark.read.parquet(str(tmp_path / "cloud.parquet")).repartition(16))
    assert len(links) >= planted and 0.99 * len(links) <= got.agg(F.sum("n_links")).first()[0] / 2 <= len(links)


def test_unseen_links():
    assert sorted_projection.unseen(0, 0) == 0 and sorted_projection.unseen(10, 4) == 9


# 9


def test_pieces_are_the_librarys(docs, none, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=suffix_sentencepiece.default_model())
    out = suffix_sentencepiece.encode(docs)
    got = collections.Counter((r.doc_id, tuple(r.pieces), r.n_pieces, r.round_trip) for r in out.collect())
    want = collections.Counter((r[0], tuple(p := sp.encode(r[1] or "")), len(p), True) for r in rows)
    assert got == want
    back = suffix_sentencepiece.decode(out.select("doc_id", "pieces"))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((r[0], r[1] or "") for r in rows)
    assert suffix_sentencepiece.encode(none).count() == 0


def test_random_texts_encode_alike():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=suffix_sentencepiece.default_model())
    e = suffix_sentencepiece.Encoder(suffix_sentencepiece.default_model())
    rng = random.Random(8)
    texts = ["".join(rng.choice("   aabthein.,!\n\té日▁\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["     " * 40, "a" * 200]
    for t, ids in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == sp.encode(t)


# 10


def test_merge_is_a_sort():
    rng = random.Random(7)
    runs = []
    for _ in range(9):
        s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40)))
        lcp = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(s, s[1:], strict=False)]
        runs.append((s, bytes(lcp[: len(s)])))
    which, place, lcp = suffix_merge_dedup.merge(runs)
    out = [runs[w][0][p] for w, p in zip(which, place, strict=True)]
    assert out == sorted(x for s, _ in runs for x in s)
    for k, a, b in zip(lcp[1:], out, out[1:], strict=False):
        assert a[:k] == b[:k] and (len(a) == k or len(b) == k or a[k] != b[k])


def test_repeats_against_brute_force(docs, none, rows):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = collections.Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(r[0], len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())] += 1
    cut = suffix_merge_dedup.cut_repeats(docs)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut.collect()) == want
    assert set(docs.columns) < set(cut.columns)
    assert suffix_merge_dedup.cut_repeats(none).count() == 0


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_merge_dedup, "_CHUNK", 1000)
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = make(700)
    table = spark.createDataFrame([(1, make(5000) + shared + make(3000)), (2, make(100) + shared)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_merge_dedup.cut_repeats(table).collect()}
    assert got == {1: (700, 1), 2: (700, 1)}
