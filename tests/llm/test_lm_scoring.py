import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tarmac.llm import lm_scoring as lm
from tests.llm.conftest import WORD, low


def base(rows):
    """doc_id, text -> (n_tokens, n_known, N, base) by plain counting."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*WORD.findall(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*WORD.findall(low(t)), None]
        out.append((i, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = lm.score(df, lm.held_out("doc_id", 7, 2)).collect()
    key = lambda x: (str(x[0]), x[1], x[2], round(x[4], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=key)
    want = sorted(base(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4]))
    assert all(r.score < 0 for r in out)
    return out


def test_documents(documents):
    check(documents)


def plain(rows, model):
    """Scores by a model that reads one bit after the other: n-grams in dictionaries, weights in lists, updated every STEP decisions."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens_of = lambda t: [*(w.encode() for w in WORD.findall(low(t))), None]

    def grams(tokens):
        full = ["start", "start", *tokens]
        return [Counter(full[2:]), Counter(zip(full[:-1], full[1:], strict=True)), Counter(zip(full[:-2], full[1:-1], full[2:], strict=True))]

    everything = [Counter(), Counter(), Counter()]
    for i, t in rows:
        if not held(i):
            for total, own in zip(everything, grams(tokens_of(t)), strict=True):
                total.update(own)
    word_hash = lambda w: 0x51A7 if w == "start" else 0xE17D if w is None else xxhash.xxh3_64_intdigest(w)

    def spelled(word):
        cost, before = 0.0, [0xFF] * 3
        for byte in [*(word or b""), 0xFF]:
            code = model.speller.code
            for k in range(code.first[byte], code.first[byte] + code.size[byte]):
                z, context = 0.0, 0
                for size, bits, table in zip((1, 2, 3), lm.TABLE_BITS, model.speller.tables, strict=True):
                    context = context << 8 | before[-size]
                    mixed = int(lm.mix64(np.array([context + (size << 56)], np.uint64))[0]) >> 32
                    slot = ((mixed ^ int(code.salt[k])) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)
                    z += float(table[slot]) * model.speller.weights[code.node[k], size - 1]
                cost += math.log1p(math.exp(-z if code.turn[k] else z))
            before.append(byte)
        return cost

    out = []
    for i, t in rows:
        tokens = tokens_of(t)
        counts = [Counter(c) for c in everything]
        if not held(i):
            for c, own in zip(counts, grams(tokens), strict=True):
                c.subtract(own)
        starts, n = counts[1]["start", "start"], sum(counts[0].values())
        weights, seen = model.mixer.weights.copy(), np.ones_like(model.mixer.weights)
        cost, past, pending, full = 0.0, [0, 0, 0], [], ["start", "start", *tokens]
        for k, w in enumerate(tokens):
            two, one = full[k], full[k + 1]
            # The occurrence just read has not been followed by anything yet.
            known = [n, counts[0][one] - 1 if k else starts, counts[1][two, one] - (k > 0)]
            mine = [counts[0][w], counts[1][one, w], counts[2][two, one, w]]
            outcome = 0
            for stage in (2, 1, 0):
                if not known[stage]:
                    continue
                hit = mine[stage] > 0
                last, level = past[-1], lambda c: min(c.bit_length(), 15)
                slots = [
                    stage * 48 + min(math.floor(2 * math.log2(known[stage])), 47), stage * 64 + last * 16 + past[-2] * 4 + past[-3],
                    (stage * 4 + last) * 256 + level(known[2]) * 16 + level(known[1]), stage * 4096 + (word_hash(one) >> 52),
                ]
                x = [*(o[s] for o, s in zip(model.mixer.odds, slots, strict=True)), 0.5]
                gate = stage * 4 + last
                p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights[gate], strict=True))))
                cost -= math.log(p if hit else 1 - p)
                pending.append((gate, [(hit - p) * v for v in x]))
                if len(pending) == lm.STEP:
                    slope = np.zeros_like(weights)
                    for g, v in pending:
                        slope[g] += v
                    seen += slope**2
                    weights += lm.RATE * slope / np.sqrt(seen)
                    pending = []
                if hit:
                    outcome, cost = stage + 1, cost + math.log(known[stage] / mine[stage])
                    break
            if not outcome:
                cost += spelled(w)
            past.append(outcome)
            n += 1
            for c, gram in zip(counts, (w, (one, w), (two, one, w)), strict=True):
                c[gram] += 1
            if k == 0:
                counts[1]["start", "start"] += 1
        out.append((i, -cost / math.log(10)))
    return out


def compare(df):
    docs = df.select("doc_id", "text", (~lm.held_out("doc_id", 7, 2)).alias("train"))
    *_, model = lm.learn(docs)
    key = lambda r: (str(r[0]), round(r[1], 4))
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()], model), key=key)
    got = sorted(((r.doc_id, r.score) for r in lm.score(df, lm.held_out("doc_id", 7, 2)).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-6 * max(1, abs(w[1])), (g, w)
    return model


def test_scores_match_a_plain_model(documents):
    """Texts of several steps among them, so that weights move."""
    model = compare(documents.filter("length(text) < 6000"))
    assert model.tokens > 1000 and any(t.any() for t in model.speller.tables)


def test_scores_of_odd_rows_match_a_plain_model(odd, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 1000)  # several blocks
    monkeypatch.setattr(lm, "PIECE", 7)
    compare(odd.filter("doc_id is null or doc_id not in (6, 8)"))


def test_no_training_texts(spark):
    df = spark.createDataFrame([(k, "one two one two") for k in range(3)] + [(3, None)], "doc_id long, text string")
    out = lm.score(df, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in out} == {(0, 0)} and all(r.score < 0 for r in out)


def test_every_training_text_counts(spark):
    """A corpus that the sample holds whole: every text's words are known by the others."""
    rows = [(k, f"the {w} cat number {k % 5} sat on the {w} mat " * 3) for k, w in enumerate(["red", "old", "big", "shy"] * 10)]
    answered, _, model = lm.learn(spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True)))
    assert model.tokens == sum(len(t.split()) + 1 for _, t in rows) and model.ends == 40
    words = {w for _, t in rows for w in t.split()}
    assert model.distinct == len(words) + 1
    turn, _, slots, _ = model.speller.code.bits(sorted(w.encode() for w in words))
    for table, slot, b in zip(model.speller.tables, slots, lm.TABLE_BITS, strict=True):
        zeros, ones = (np.bincount(slot[turn == t], minlength=1 << b) for t in (0, 1))
        assert np.array_equal(table, lm._log_odds(zeros, ones))


def test_copies_score_apart(spark):
    """A text that occurs twice is known by its copy, wherever the copy is; one that occurs once is not."""
    words = [f"w{k * 7919 % 501}" for k in range(60_000)]
    texts = [" ".join(words[k * 131 % 50_000 + k :][:80]) + f" x{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(20)], "doc_id long, text string")
    out = {r.doc_id: r.score / r.n_tokens for r in lm.score(docs, lm.held_out("doc_id", 7, 2)).collect()}
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    copied = [max(out[k], out[1000 + k]) for k in range(20) if train(k) or train(1000 + k)]
    assert min(copied) > -1 and len(copied) > 15


def test_odd_rows(odd):
    check(odd)


def test_empty(odd):
    assert lm.score(odd.limit(0)).count() == 0


def test_held_out_texts_cost_few_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score(docs, lm.held_out("doc_id", 7, 2))
    sizes = {r.doc_id: r.n for r in docs.selectExpr("doc_id", "octet_length(text) AS n").collect()}
    held = [r for r in out.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    bits = -sum(r.score for r in held) / math.log10(2) / sum(sizes[r.doc_id] for r in held)
    assert bits < 2.2


def test_spelled_symbols_have_total_probability_one():
    rng = np.random.default_rng(3)
    speller = lm.Speller(lm.Code(np.arange(256)), [rng.integers(-60, 60, 1 << b).astype(np.int8) for b in lm.TABLE_BITS])
    end = speller.cost([b""])[0]
    total = math.exp(-end)
    for b in range(255):
        word = bytes([b])
        turn, node, x, _ = speller.inputs([word])
        z = (x * speller.weights[node]).sum(1) * (turn * 2.0 - 1)
        total += math.exp(-np.logaddexp(0, -z)[: speller.code.size[b]].sum())
    assert abs(total - 1) < 1e-9


def test_packing():
    for values in ([], [0, 0], [1, 255, 256], [2**63, 5], range(1000)):
        assert np.array_equal(lm.unpack(lm.pack(np.array(list(values), np.uint64))), np.array(list(values), np.uint64))


def test_all_training_texts_are_fitted(spark):
    """A text far longer than the others sets the code and the predictors' counts, as most tokens are its."""
    rows = [(k, " ".join(f"q{k * 31 + j}" for j in range(20))) for k in range(30)] + [(99, "zz yz zy " * 60_000)]
    *_, model = lm.learn(spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True)))
    size = model.speller.code.size
    assert size[ord("z")] < size[ord("q")]
    assert model.mixer.odds[1][2 * 64 + 63] > 5  # after three tokens known by two words before: in the long text alone


def test_forms_of_parts_add_up():
    """Newton steps on parts, summed, come near the least of the whole."""
    rng = np.random.default_rng(5)
    x, true, start = rng.normal(size=(160_000, 3)), np.array([0.5, -0.3, 1.0]), np.full((1, 3), 0.3)
    y = (rng.random(160_000) < 1 / (1 + np.exp(-x @ true))).astype(np.uint8)
    parts = sum(lm.form(x[a : a + 20_000].T, y[a : a + 20_000], np.array([0, 20_000]), start, 30.0, lm.LOOKS) for a in range(0, 160_000, 20_000))
    near, w = lm.solved(parts, start, 30.0), start
    for _ in range(20):
        w = lm.solved(lm.form(x.T, y, np.array([0, 160_000]), w, 30.0, 1), start, 30.0)
    assert np.abs(near - w).max() < 0.02 and np.abs(w - true).max() < 0.1


def test_order_of_hashes():
    rng = np.random.default_rng(6)
    for x in (rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 50, 5000, np.uint64), np.zeros(0, np.uint64), np.array([5, 3, 2**64 - 1], np.uint64)):
        assert np.array_equal(lm.ascending(x), np.argsort(x, kind="stable"))
