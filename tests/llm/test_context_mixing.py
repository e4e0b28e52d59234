import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa

from tessera.llm import context_mixing as M
from tessera.sources.tables import table


def _base(rows):
    words = [brute.WORD.findall(brute.lower(t)) for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter()
    for w, h in zip(words, held):
        if not h:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    out = []
    for (d, _), w, h in zip(rows, words, held):
        t = [*w, None]
        out.append((d, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    return out


def _check(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, score string")
    out = M.score_documents(df).collect()
    got = sorted((str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)), r.base_score) for r in out)
    want = sorted((str(x[:5]), x[5]) for x in _base(rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])
    assert all(r.score <= 0 and math.isfinite(r.score) for r in out)
    return out


def test_base_and_edges(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["", " ", "\n\t"]) + " ".join(rnd.choice(["the", "Then", "of", "É", "x" * 30, "a.b"]) for _ in range(rnd.randint(0, 60)))
             + rnd.choice(["", " ", " \n\n"])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (3, rows[3][1]), (3, rows[3][1]), (None, "no id the"), (203, "word " * 30_000)]
    out = _check(spark, rows)
    same = {round(r.score, 9) for r in out if r.doc_id == 3}
    assert len(same) == 1


def test_no_training_and_empty(spark):
    held = [(i, f"held {i}") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    _check(spark, held)
    _check(spark, [])


def _units(words, counts, kind=0, z=0):
    n = len(words)
    return pa.table({"kind": pa.array([kind] * n, pa.int8()), "z": pa.array([z] * n, pa.int8()), "word": pa.array(words, pa.binary()),
                     "cz": pa.array(counts, pa.int64())})


def _random_mixing(rng, code):
    return {"code": code, "w": rng.normal(0.3, 0.2, (M.SETS, len(M.ORDERS) + 1)), "map": rng.random((M.SETS, M.MAP_STEPS))}


def test_bytes_of_a_context_add_up_to_one():
    """The probabilities of all bytes after a prefix, on the path that scores: bit counts, inputs, mix."""
    rng = np.random.default_rng(1)
    learnt = _units([b"t" + bytes([b]) for b in (0x20, 0x41, 0x61, 0xC3, 0xFF)] + [b"the", b"a"], [3, 1, 7, 2, 1, 9, 4], kind=1)
    keys, n = M._own_keys(learnt)
    code = M.byte_code(rng.integers(0, 1000, 256))
    model = M._bit_counts(keys, n, code)
    asked = _units([b"t" + bytes([b]) for b in range(256)], [0] * 256, kind=1)
    for mixing in (_random_mixing(rng, code) for _ in range(3)):
        x, gate, y, row, _ = M._exact_inputs(model, asked.to_batches()[0], False)
        assert abs((10 ** M._log_mix(mixing, x, gate, y, row, 256)).sum() - 1) < 1e-6


def test_scores_against_plain_python():
    """Whole counts, logits, gates, mix and map of every bit, one after the other."""
    rng = np.random.default_rng(2)
    words, counts = [b"the", b"then", b"a", "é".encode(), b"xyx"], [9, 2, 30, 1, 0]
    units = _units(words, counts, z=2)
    code = M.byte_code(rng.integers(0, 50, 256))
    mixing = _random_mixing(rng, code)
    keys, n = M._own_keys(units)
    model = M._bit_counts(keys, n, code)
    ones, zeros = Counter(), Counter()
    path = lambda b: [(int(code["node"][i]), int(code["turn"][i])) for i in range(code["start"][b], code["start"][b] + code["size"][b])]

    def contexts(w, at):
        return [(k, w[max(0, at - o):at]) for k, o in enumerate(M.ORDERS)]  # one class here

    coded = [w + bytes([M.END_WORD]) for w in words]
    for w, c in zip(coded, counts):
        for at, b in enumerate(w):
            for k, ctx in contexts(w, at):
                for node, turn in path(b):
                    (ones if turn else zeros)[k, ctx, node] += c
    x, gate, y, row, _ = M._exact_inputs(model, units.to_batches()[0], False)
    got = M._log_mix(mixing, x, gate, y, row, len(words))
    for w, lp in zip(coded, got):
        want = 0.0
        for at, b in enumerate(w):
            for node, turn in path(b):
                n1, n0 = ([t[k, ctx, node] for k, ctx in contexts(w, at)] for t in (ones, zeros))
                logits = [math.log((p + 0.05) / (q + 0.05)) for p, q in zip(n1, n0)] + [0.3]
                level = [min(int(math.log2(p + q + 1)), M.GATES - 1) for p, q in zip(n1, n0)]
                g = 8 + level[5] if level[5] else 16 + level[4] if level[4] else level[3]
                z = sum(v * u for v, u in zip(logits, mixing["w"][g]))
                spot = (min(max(z, -7.99), 7.99) + 8) * (M.MAP_STEPS - 1) / 16
                low = int(spot)
                m = mixing["map"][g][low] * (1 - spot + low) + mixing["map"][g][low + 1] * (spot - low)
                p = min(max((1 / (1 + math.exp(-z)) + m) / 2, 1e-6), 1 - 1e-6)
                want += math.log10(p if turn else 1 - p)
        assert abs(lp - want) < 1e-4 * max(1, abs(want)), (w, lp, want)


def test_learns_the_corpus(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = _check(spark, rows)
    held = [r for r in out if r.held_out and r.n_tokens > 50]
    assert sum(r.bits_per_byte for r in held) / len(held) < 3  # eight without a model
    shuffled = [(d, "".join(random.Random(d).sample(t, len(t)))) for d, t in rows]
    both = M.score_documents(spark.createDataFrame(rows + [(10_000 + d, t) for d, t in shuffled if zlib.crc32(str(10_000 + d).encode()) % 5 == 1],
                                                   "doc_id long, text string")).collect()
    worse = [r.bits_per_byte for r in both if r.doc_id >= 10_000 and r.n_tokens > 20]
    assert min(worse) > max(r.bits_per_byte for r in held)


def test_counts_are_whole(spark):
    """Every (predictor, context, byte) has its whole count in every block, words seen once too."""
    rnd = random.Random(5)
    words = list({"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 12))).encode() for _ in range(800)})
    rows = [(i % 7, 0, i % 3, bytearray(w), 1 if i % 4 else rnd.randint(0, 40), 0, [0]) for i, w in enumerate(words)]
    units = spark.createDataFrame(rows, "mb int, kind byte, z byte, word binary, cz long, c long, blocks array<int>")
    t = pa.table({"kind": pa.array([0] * len(rows), pa.int8()), "z": pa.array([r[2] for r in rows], pa.int8()),
                  "word": pa.array(words, pa.binary()), "cz": pa.array([r[4] for r in rows], pa.int64())})
    (ctx, byte, row), _, c = M._columns(t.to_batches()[0], "cz")
    want = Counter()
    for key, n in zip(M._pair_keys(ctx, byte).tolist(), np.tile(c[row], len(M.ORDERS)).tolist()):
        want[key] += int(n)
    blocks = M.block_models(units, 5).collect()
    assert len(blocks) == 7
    for b in blocks:
        u, keys, n = M._whole_counts({c: bytes(v) for c, v in b.asDict().items()})
        got = dict(zip(keys.tolist(), n.tolist()))
        assert all(want[k] == n for k, n in got.items())
        (ctx, byte, _), _, _ = M._columns(u.to_batches()[0], "cz")
        asked = set((M._pair_keys(ctx, byte) >> np.uint64(8)).tolist())
        assert {k for k, n in want.items() if n and k >> 8 in asked} == set(got)


def test_words_seen_once_are_known(spark):
    """Held-out words that training saw once score far better than words that it never saw."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
    once, often = [word() for _ in range(2000)], [word() for _ in range(2000)]
    running = once + often + often
    rnd.shuffle(running)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:300]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:40]
    rows = [(d, " ".join(running[20 * k:20 * k + 20])) for k, d in enumerate(train)]
    rows += [(d, " ".join(rnd.sample(once, 20) if k % 2 else [word() for _ in range(20)])) for k, d in enumerate(held)]
    bits = {r.doc_id: r.bits_per_byte for r in M.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    known, new = (sum(bits[d] for d in held[k::2]) / len(held[k::2]) for k in (1, 0))
    assert known < 0.25 * new, (known, new)


def test_classes_come_from_all_distinct_texts(spark):
    """Copies count once and long texts count: six alphabets give six classes."""
    rnd = random.Random(4)
    text = lambda k, n: "".join(chr(97 + 4 * k + rnd.randrange(4)) for _ in range(n))
    texts = [text(k, 300) for k in range(5) for _ in range(20)] + [text(5, 40_000) for _ in range(3)]
    low = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("min_by(text, xxhash64(text)) AS t").first().t
    rows = spark.createDataFrame([(t,) for t in texts + [low] * 2500], "text string")
    centres = M.fit_classes(rows)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    z = M.classes_of(centres, np.concatenate(data), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    groups = [set(z[20 * k:20 * k + 20].tolist()) for k in range(6)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 6, groups
    assert np.allclose(centres, M.fit_classes(rows.repartition(7)), atol=1e-5)


def test_words_of_a_block_travel_packed():
    """A block sends at most one row a part, and the parts add up to what plain Python counts."""
    rnd = random.Random(9)
    texts = [rnd.choice(["", " ", "\n"]) + " ".join(rnd.choice(["The", "of", "É", "x" * 40, "a.b"]) + rnd.choice(["", "1"]) for _ in range(rnd.randint(0, 30)))
             + rnd.choice(["", "  "]) for _ in range(60)]
    held = [i % 4 == 0 for i in range(60)]
    centres = np.random.default_rng(4).random((M.CLASSES, M.PAIRS)).astype(np.float32)
    sent = [M._block_words(pa.table({"block": pa.array([k] * 20, pa.int32()), "text": texts[20 * k:20 * k + 20], "held": held[20 * k:20 * k + 20]}), centres, 4)
            for k in range(3)]
    assert all(t.num_rows <= 4 for t in sent)
    packed = pa.concat_tables(sent)
    got = [r for p in range(4) for t in [packed.filter(pa.array(packed["part"].to_numpy() == p))] if t.num_rows
           for r in M._part_words(t.drop_columns(["part"])).to_pylist()]
    low = [brute.lower(t).encode() for t in texts]
    z = M.classes_of(centres, np.frombuffer(b"".join(low), np.uint8), np.cumsum([0, *map(len, low)]))
    whole, by_class, blocks, coded = Counter(), Counter(), {}, Counter()
    for i, t in enumerate(low):
        for w in brute.WORD.findall(t.decode()):
            w = w.encode()
            whole[w] += not held[i]
            by_class[w, z[i]] += not held[i]
            blocks.setdefault((w, z[i]), set()).add(i // 20)
            if not held[i]:
                coded.update(w + bytes([M.END_WORD]))
    words = [r for r in got if r["kind"] == 0]
    assert {(r["word"], r["z"]): (r["c"], r["cz"], set(r["blocks"])) for r in words} == {k: (whole[k[0]], by_class[k], b) for k, b in blocks.items()}
    assert len(words) == len(blocks) and sum(r["new"] for r in words) == len(whole)
    for r in got:
        if r["kind"] == 1:
            coded.update({b: r["c"] * n for b, n in Counter(r["word"][1:]).items()})
    assert {r["word"][0]: r["c"] for r in got if r["kind"] == 3} == {b: n for b, n in coded.items() if n}


def test_words_with_one_hash_stay_apart(monkeypatch):
    rows = [(b"b", 0, 1, 2), (b"a", 0, 1, 3), (b"b", 0, 2, 4), (b"a", 1, 0, 5), (b"a", 0, 1, 6)]
    word, kind, z, n = zip(*rows)
    t = pa.table({"block": pa.array([7], pa.int32()), "word": [b"".join(word)], "size": [np.ones(5, np.int32).tobytes()],
                  "kind": [bytes(kind)], "z": [bytes(z)], "n": [np.array(n).tobytes()]})
    want = [(0, 1, b"a", True, 9, 9), (0, 1, b"b", True, 6, 2), (0, 2, b"b", False, 6, 4), (1, 0, b"a", True, 5, 5)]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(M, "_word_hashes", lambda words, kind: np.zeros(len(words), np.uint64))
        got = M._part_words(t).to_pylist()
        assert sorted((r["kind"], r["z"], r["word"], r["c"], r["cz"]) for r in got) == sorted(w[:3] + w[4:] for w in want)
        assert Counter((r["kind"], r["word"]) for r in got if r["new"]) == Counter({(0, b"a"): 1, (0, b"b"): 1, (1, b"a"): 1})


def test_scores_come_from_stored_paths():
    """Learning keeps the counts on the paths; scoring reads them and gives what whole counts give."""
    rng = np.random.default_rng(6)
    words = sorted({bytes(rng.integers(97, 101, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)} | {"é".encode(), b"once"})
    cz = rng.integers(0, 5, len(words))
    units = _units(words, cz, z=1).append_column("c", pa.array(cz)).append_column("blocks", pa.array([[0]] * len(words), pa.list_(pa.int32())))
    code = M.byte_code(rng.integers(0, 50, 256))
    mixing = _random_mixing(rng, code)
    keys, n = M._own_keys(units)
    own = M._asked(units.to_batches()[0])["keys"]
    keys, n = keys[n > 0], n[n > 0]
    m = np.array([int(((keys >> np.uint64(8)) == c).sum()) for c in np.unique(own >> np.uint64(8))])
    learnt = M._learn_block(units, m, (keys & np.uint64(255)).astype(np.uint8), n, code)

    class Rows:
        def select(self, *names):
            self.names = list(names)
            return self

        def mapInArrow(self, run, schema):
            assert not {"m", "b", "n"} & set(self.names)
            return list(run(learnt.select(self.names).to_batches()))

    got = M.score_units(Rows(), mixing)[0].column("lp").to_numpy()
    x, gate, y, row, _ = M._exact_inputs(M._bit_counts(keys, n, code), units.to_batches()[0], False)
    assert np.allclose(got, M._log_mix(mixing, x, gate, y, row, len(words)), atol=1e-9)
