"""Each corpus operator against a brute-force version, and on nulls, empties, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as pt
import pytest

from threadlake.llm import bpe, chat_format, embedding_dedup, exact_dedup, minhash, mixing, sharding, token_counts, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "rid string, rec string, norm string, gid int, size int, shard int, comp int, node int, n int, src int, score int, block int"
WORDS = "the of and to in re ti on an er at es en edha thion ingly sch keit ung café niño".split()


def make_docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    extra = ("x", "y", "z", 1, 2, 3, 4, 5, 6, 7, 8, 9)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *extra) for i, t, s in rows], f"{DOCS}, {CLASH}")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ed", "s", ".", ","]) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    for k in range(15):
        words = texts[k].split()
        for _ in range(rng.randint(0, max(1, len(words) // 30))):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), "", None, "", "one two three", "ONE  two\tthree", "x", " \n ", "é" * 3000, prose(rng, 5000)]
    return [(i, t, f"s{i % 5}" if i % 7 else None) for i, t in enumerate(texts)]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_url_filter(spark):
    urls = ["http://example.org/es/a", "https://EXAMPLE.org/en/12?q", "http://a.b.org/x", "http://org/", "http://org", "http://xorg/", "http://m.com/fr/", "http://m.com/de/x#y", "http://m.com/french", "ftp://com/de/", "no scheme", "", None, "http://example.org/ES/", "http://example.org.evil/es/", "x://a.org/p://b.com/de/", "http://m.com/fr/"]
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    from threadlake.llm.queries import RULES

    want = {}
    for i, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = low(rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        want[i] = (host, path, best and best.text, best.verdict if best else "allow")
    for inline in (256, 0):
        url_filter.INLINE_RULES, kept = inline, url_filter.INLINE_RULES
        try:
            got = {r["rec"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, RULES).collect()}
        finally:
            url_filter.INLINE_RULES = kept
        assert got == want
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}
    assert dict((r.text, t) for t, r in url_filter.index(RULES))["example.org/es/"] == "es"
    star = [url_filter.Rule("a.org", "/x*z/", "block")]
    got = url_filter.judge(spark.createDataFrame([("http://a.org/x123z/",), ("http://a.org/x123/",)], "url string"), star).orderBy("verdict").collect()
    assert [r["verdict"] for r in got] == ["allow", "block"]


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 2, "bob", "hello"), (1, None, "ann", None), (2, 0, "system", "alone"), (None, 0, None, "who"), *[(3, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(11)]]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn int, role string, text string, pos string")
    out = chat_format.rotate(df, part_turns=4)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["part"]):
        text, spans = got.setdefault((r["conv_id"], r["perspective"]), ["", []])
        got[r["conv_id"], r["perspective"]] = [text + r["text"], spans + [(m["start"] + len(text), m["end"] + len(text)) for m in r["mask"]]]
    want = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or ""))
        for who in {t[2] or "unknown" for t in own} - {"system"}:
            text, spans = "", []
            for _, _, speaker, body in own:
                speaker, body = speaker or "unknown", body or ""
                name = "assistant" if speaker == who else "system" if speaker == "system" else f"user name={speaker}"
                text += f"<|im_start|>{name}\n"
                if speaker == who:
                    spans.append((len(text), len(text) + len(body) + len("<|im_end|>\n")))
                text += body + "<|im_end|>\n"
            want[conv, who] = [text, spans]
    assert got == want
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_exact_dedup(spark):
    rows = corpus() + [(None, "null id", None), (5000, "null id", None), (7, "tie", "a"), (7, "tie", "a")]
    rows += [(6000 + k, "p" * 48 + "q" * n, None) for k, n in enumerate((0, 0, 1, 335, 336, 336, 337, 3000, 3000))]
    got = exact_dedup.report(make_docs(spark, rows)).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.keep_one(make_docs(spark, rows))
    assert kept.count() == len(groups) and "gid" in kept.columns
    assert exact_dedup.report(make_docs(spark, [])).count() == 0


def reference_encoding():
    import tiktoken

    m = bpe.merges(pt.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=m.ranks, special_tokens={})


def test_bpe(spark):
    rng = random.Random(5)
    odd = "aab \n\t'sé1２½ß中🙂 é<|endoftext|>\x1c\x85\u2028  ll're"
    rows = corpus() + [(1000 + k, "".join(rng.choice(odd) for _ in range(rng.randint(0, 80))), None) for k in range(300)] + [(None, "aaaaaaaa" * 50, None), (2**60 + 1, "x", None)]
    enc = reference_encoding()
    out = bpe.encode(make_docs(spark, rows), pt.path("byte_bpe_multi_50k.tiktoken"), pt.PATTERN)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    want = Counter()
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want[i, tuple(ids), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = {r["rec"]["doc_id"]: r["text"] for r in bpe.decode(out, pt.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert bpe.encode(make_docs(spark, []), pt.path("byte_bpe_multi_50k.tiktoken"), pt.PATTERN).count() == 0


def test_bpe_word_redone_when_an_earlier_merge_comes_late():
    m = bpe.Merges.__new__(bpe.Merges)
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"cd": 256, b"abcd": 257, b"ab": 258, b"bcd": 300, b"xab": 259}
    m.ranks = ranks
    m.tokens = {r: t for t, r in ranks.items()}
    pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
    m.keys, m.merged = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
    m.byte_ids = np.arange(256, dtype=np.int32)
    for w in (b"xabcdabcd", b"abcdxab", b"cdcdab"):
        flat, starts, lens = m.replay([w])
        assert flat[starts[0] : starts[0] + lens[0]].tolist() == m.one_by_one(w).tolist()


def test_blocks_keep_all_rows():
    import pandas as pd

    frames = [pd.DataFrame({"doc_id": range(k, k + 5), "text": ["x" * n for n in (0, 30, 5, 5, 200)]}) for k in (0, 5, 10)]
    out = list(bpe.blocks(iter(frames), 40))
    assert [i for b in out for i in b["doc_id"]] == list(range(15)) and len(out) > 3


def unit_vectors(seed=3, n=300, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    v = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.05, 0.2, 0.35], (n, 1))
    return [[float(np.float32(x)) for x in r] for r in v]


@pytest.mark.parametrize("sizes", [{}, {"block": 5, "fan_out_bits": 1}])
def test_embedding_dedup(spark, sizes):
    """With blocks of five vectors and two intervals in the one above, the descent has many levels."""
    v = unit_vectors()
    rows = [(i, x, i % 3) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [1.0, None] * 6, 1), (1004, v[0], None), (1005, v[0][:5], 0), (1006, v[0][:5], 0), (1007, [], 0), (1008, [float("inf")] + v[0][1:], 0), (0, v[0], 0), (None, v[1], 1), (1009, [x * 1e30 for x in v[2]], 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node int, comp string")
    got = embedding_dedup.report(df, **sizes).collect()
    ok = lambda x: x and all(y is not None and np.isfinite(y) for y in x) and any(x)
    n, parent = len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a):
            (_, x, la), (_, y, lb) = rows[a], rows[b]
            if la is not None and la == lb and ok(x) and ok(y) and len(x) == len(y):
                x, y = np.float32(x).astype(float), np.float32(y).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    comps = {}
    for a in range(n):
        comps.setdefault(root(a), []).append(a)
    want = Counter()
    for members in comps.values():
        ids = [rows[a][0] for a in members if rows[a][0] is not None]
        for a in members:
            want[rows[a][0], links[a], min(ids, default=None)] += 1
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(comps)
    assert embedding_dedup.report(df.limit(0)).count() == 0
    assert embedding_dedup.report(df.where("vec_id = 1000")).count() == 1


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = pt.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = corpus() + [(2000, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", None), (2001, "İstanbul ΣΑΣ ﬁ ½ e\u0301\u00a0x\u2003y\x1cz\x0bq", None), (2002, "don't  we'll\r\n I'm", None)]
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds all it needs stored
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.report(make_docs(spark, rows), path, cache=cache).collect())
        want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids), len(tok.encode(t or "", add_special_tokens=False).ids) > 2048) for i, t, _ in rows)
        assert got == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()
    whole = token_counts.count(make_docs(spark, rows[:20]), path, by_word=False)
    assert {r["doc_id"]: r["n_tokens"] for r in whole.collect()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows[:20]}
    assert token_counts.report(make_docs(spark, []), path).count() == 0


def mix_targets(sizes, weights, most):
    """Shares by weight, one source over its bound at a time."""
    closed, out = set(), [0.0] * len(sizes)
    while len(closed) < len(sizes):
        rest, weight = sum(sizes) - sum(most * sizes[i] for i in closed), sum(w for i, w in enumerate(weights) if i not in closed)
        share = {i: rest * weights[i] / weight for i in range(len(sizes)) if i not in closed}
        over = [i for i in share if share[i] > most * sizes[i]]
        if not over:
            return [share.get(i, most * sizes[i]) for i in range(len(sizes))]
        closed.add(over[0])
    return [most * s for s in sizes]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a", "b", "c", "d", "é", None, "empty"])) for i in range(800)]
    rows = [(i, "" if s == "empty" else t, s) for i, t, s in rows] + [(900, None, "a"), (7, rows[7][1], "z"), (None, "no id", "z")]
    df = make_docs(spark, rows)
    out = mixing.mix(df)
    got = out.select("rec.doc_id", "rec.source", "rec.text", "size", "source_size", "target", "draws").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    aims = mix_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    target = dict(zip(order, aims, strict=True))
    taken, per_shard = Counter(), Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and len(r["draws"]) <= 3
        taken[r["source"]] += r["size"] * len(r["draws"])
        per_shard.update(d["shard"] for d in r["draws"])
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in order:
        assert abs(taken[s] - target[s]) <= 30
    # Blocks are finer than shards: all shards get rows, in like numbers.
    assert set(per_shard) == set(range(mixing.SHARDS)) and max(per_shard.values()) <= 2.5 * min(per_shard.values())
    assert len({(d["shard"], d["order"]) for r in got for d in r["draws"]}) >= 0.99 * sum(per_shard.values())
    again = mixing.report(make_docs(spark, random.Random(9).sample(rows, len(rows))))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixing.report(df).collect()), key=str)
    assert mixing.rows(out).count() == sum(len(r["draws"]) for r in got)
    assert mixing.report(make_docs(spark, [])).count() == 0


def test_mixing_quotas(spark):
    """Every block's draws as a plain replay of the quotas gives them, and the tree's counts as the shards show them."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(1, 30)), f"s{rng.choice('aaaabbcd')}") for i in range(1500)]
    docs = make_docs(spark, rows + rows[:3])  # with fully repeated rows
    got = mixing.mix(docs, shards=5, block_docs=4).select("rec.source", "size", "source_size", "target", "draws").collect()
    assert len(got) == 1503
    for source in "abcd":
        own = [r for r in got if r["source"] == f"s{source}"]
        whole = min(3, int(own[0]["target"] // own[0]["source_size"]))
        assert all(whole <= len(r["draws"]) <= whole + 1 and [d["pass"] for d in r["draws"]] == list(range(len(r["draws"]))) for r in own)
        assert abs(sum(r["size"] * len(r["draws"]) for r in own) - own[0]["target"]) <= 15
        # All shards get of every source, and no shard the same pass of a document twice.
        assert {d["shard"] for r in own for d in r["draws"]} == set(range(5))
    again = mixing.mix(docs, shards=5, block_docs=4).select("rec.doc_id", "draws").collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(docs.repartition(7), shards=5, block_docs=4).select("rec.doc_id", "draws").collect()))


def test_mixing_targets_and_tree(spark):
    for sizes, weights in (([10, 100, 100], [5, 2, 1]), ([0, 0], [1, 1]), ([1, 1, 1000, 50], [5, 2, 1, 5]), ([7], [5])):
        df = spark.createDataFrame([(w, float(v)) for w, v in zip(sizes, weights, strict=True)], "words bigint, weight double")
        assert [r["target"] for r in mixing.with_targets(df, 3).collect()] == pytest.approx(mix_targets(sizes, weights, 3))
    tree = mixing.split_tree(np.random.default_rng(0), [100, 7, 0, 53], 8)
    assert [sum(c) for c in zip(*tree, strict=True)] == [100, 7, 0, 53] and {sum(r) for r in tree} == {20}


def shingles(t):
    w = low(t).encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(a) for a in range(len(rows))], sets


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_minhash(spark, rounds, monkeypatch):
    """With small blocks and squares, so that one group spans many of them."""
    for name, value in {"PIVOT_ROUNDS": rounds, "BLOCK_LEFT": 6, "BLOCK_RIGHT": 9, "SQUARE_LEFT": 2, "SQUARE_RIGHT": 4, "SQUARE_SHINGLES": 64}.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(8)
    base = prose(rng, 80).split()
    rows = corpus(4) + [(3000 + k, " ".join("new" if rng.random() < 0.01 else w for w in base), None) for k in range(25)] + [(None, "lone null id here and more", None)]
    rows += [(3000, " ".join(base), None)]
    base = prose(rng, 150).split()  # a group whose pairs lie on both sides of the threshold
    rows += [(4000 + k, " ".join(f"n{rng.random()}" if rng.random() < 0.02 else w for w in base), None) for k in range(60)]
    comp, sets = near_components(rows)
    got = minhash.report(make_docs(spark, rows)).collect()
    ids = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    want = Counter((rows[k][0], len(sets[k]), ids[comp[k]]) for k in range(len(rows)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(ids)


def test_minhash_recall_near_the_threshold(spark):
    """Planted pairs of a similarity from 0.75 to 0.80: none is lost."""
    rng, rows, pairs = random.Random(3), [], 0
    while pairs < 400:
        a = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        b = [f"w{rng.randrange(5000)}" if rng.random() < 0.027 else w for w in a]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if 75 <= 100 * len(x & y) / len(x | y) <= 80:
            rows += [(2 * pairs, " ".join(a), None), (2 * pairs + 1, " ".join(b), None)]
            pairs += 1
    assert minhash.report(make_docs(spark, rows)).where("component_id = doc_id - 1").count() == pairs


def test_minhash_empty(spark):
    assert minhash.report(make_docs(spark, [])).count() == 0
    assert minhash.keep_one(make_docs(spark, [(1, "", None), (2, None, None)])).count() == 2


def test_minhash_estimate(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, minhash.HASHES, dtype=np.uint32)
    b = a.copy()
    b[: minhash.HASHES // 4] = rng.integers(0, 2**32, minhash.HASHES // 4, dtype=np.uint32)
    lanes = lambda x: [(int(v) >> 4 * k) & 15 for v in minhash.pack(x).view(np.uint64) for k in range(16)]
    same = sum(x == y for x, y in zip(lanes(a), lanes(b), strict=True)) / minhash.HASHES
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(minhash.pack(a).tolist(), minhash.pack(b).tolist())], "a array<bigint>, b array<bigint>")
    got = df.select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx((same - 1 / 16) / (15 / 16)) and abs(got - 0.75) < 0.05


def test_sharding(spark):
    rows = corpus() * 4 + [(None, None, None)] * 3
    df = make_docs(spark, rows)
    got = sharding.report(df, shards=7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(s) for s in slots.values()]
    assert len(slots) == 7 and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.report(make_docs(spark, random.Random(1).sample(rows, len(rows))), shards=7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.report(make_docs(spark, [])).count() == 0
    assert sharding.report(make_docs(spark, rows[:3]), shards=7).count() == 3


def test_sharding_through_a_deep_matrix(spark):
    """Partitions of a few rows and two branches a node: the matrix has many levels, its sums are exact."""
    rows = [(i, f"t{i}", None) for i in range(400)] + [(7, "t7", None)] * 30
    df = make_docs(spark, rows)
    got = sharding.report(df, shards=6, partition_rows=9, fan_out_bits=1).collect()
    counts = Counter(r["shard"] for r in got)
    assert sorted(counts.values()) == [71, 71, 72, 72, 72, 72]
    for k in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))
    again = sharding.report(df.repartition(5), shards=6, partition_rows=9, fan_out_bits=1).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_sharding_written_with_clashing_columns(spark, tmp_path):
    sharding.write(sharding.shuffle(make_docs(spark, corpus()), shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["rec", "slot", "shard"] and back.count() == len(corpus()) and "shard" in back.select("rec.*").columns


def test_communication_matrix():
    rng = np.random.default_rng(1)
    m = sharding.communication_matrix(rng, [100, 0, 37, 5], sharding.even(142, 6))
    assert [sum(r) for r in m] == [100, 0, 37, 5] and sorted(sum(c) for c in zip(*m, strict=True)) == [23, 23, 24, 24, 24, 24]
    mean = np.mean([sharding.communication_matrix(rng, [30, 10], [10] * 4) for _ in range(300)], axis=0)
    assert abs(mean - np.array([[7.5] * 4, [2.5] * 4])).max() < 0.4


def test_hypergeometric_law():
    """Against the law itself for small numbers, against its mean and variance for numbers of any size."""
    import math

    rng, n = np.random.default_rng(5), 20_000
    for good, bad, draws in ((30, 45, 25), (60, 20, 50), (12, 300, 40)):
        seen = np.bincount([sharding.hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=draws + 1)
        law = n * np.array([math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(draws + 1)])
        usual = law > 10
        assert ((seen - law)[usual] ** 2 / law[usual]).sum() < 2.5 * usual.sum()
    for good, bad, draws in ((10**12, 3 * 10**12, 10**12), (10**14, 10**13, 10**7), (25, 10**12, 10**11)):
        x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(n)], float)
        total = good + bad
        mean, var = draws * good / total, draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))
        assert abs(x.mean() - mean) < 5 * math.sqrt(var / n) and abs(x.var() / var - 1) < 0.06
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 0, 0) == 0


def toxic_corpus(seed=0, n=600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        words = prose(rng, rng.randint(10, 150)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "trashest", "trashing"]))
        rows.append((i, " ".join(words), "s"))
        if rng.random() < 0.7:
            labels.append((i, 1, int(bad)))
    return rows, labels, {i for i, t, _ in rows if any(w in t for w in ("idiot", "scum", "trash"))}


def test_toxicity(spark):
    rows, labels, bad = toxic_corpus()
    rows += [(5000, None, None), (5001, "", None), (None, "idiot scum", None), (0, rows[0][1], "s")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5001, None, None)], "doc_id bigint, quality int, toxic int")
    docs = make_docs(spark, rows)
    got = toxicity.report(docs, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    right = sum((r["doc_id"] in bad) == bool(r["predicted"]) for r in held)
    assert right >= 0.95 * len(held)
    assert {r["score"] for r in got if r["doc_id"] in (5000, 5001)} < {r["score"] for r in got if r["predicted"] == 0} | {0.0}
    clean = toxicity.keep_clean(docs, lab)
    assert clean.columns == docs.columns and clean.count() == sum(not r["predicted"] for r in got)
    none = lab.where("toxic = 0")
    assert {r["score"] for r in toxicity.report(docs, none).collect()} == {0.0}
    assert toxicity.report(make_docs(spark, []), lab).count() == 0


def test_toxicity_scores_by_hand_and_odd_input(spark):
    rows, labels, _ = toxic_corpus()
    docs = make_docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r["rec"]["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in rows:
        z = model.bias + sum(w for f, w in model.weights.items() if f in toxicity.features(r[1]))
        assert abs(got[r[0]] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9
    empty = lab.where("false")
    assert {r["score"] for r in toxicity.report(docs, empty).collect()} == {0.0}
    word = max(model.weights, key=model.weights.get).lstrip("^")
    long = make_docs(spark, [(1, "plain " * 400_000 + word * 2, "s"), (1, "plain " * 400_000 + word * 2, "s"), (None, None, None), (3, "", None)])
    out = toxicity.report(long, lab).collect()
    assert len(out) == 4 and len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert toxicity.keep_clean(long, lab).columns == long.columns


def test_toxicity_features_are_counted_over_all_texts(spark):
    rows, labels, _ = toxic_corpus()
    docs = make_docs(spark, rows)
    bad = {d for d, _, t in labels if t}
    texts = [r[1] for r in rows if r[1]]
    positive = [r[1] for r in rows if r[0] in bad and r[1]]
    prior, n, m = 0.2, len(positive), len(texts)
    want = []
    for f in sorted(set().union(*map(toxicity.features, positive))):
        p, u = sum(f in toxicity.features(t) for t in positive), sum(f in toxicity.features(t) for t in texts)
        neg = max(0.0, (u / m - prior * p / n) / (1 - prior))
        z = (p / n - neg) / math.sqrt((neg + 1 / m) * (1 - min(neg, 0.999)) / n)
        if p >= max(toxicity.LEAST_POSITIVES, toxicity.LEAST_SHARE * n) and z >= toxicity.LEAST_Z:
            want.append((-z, f))
    want = [f for _, f in sorted(want)]
    df = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string").repartition(5)
    assert want and toxicity.telling(df(positive), df(texts), n, m, prior) == want
    assert toxicity.telling(df(positive), df(texts), n, m, prior, 3) == want[:3]


def risk_parts(p, u, w, b, prior):
    """Prior-weighted risk of the positives, and that of the negatives as the prior leaves it, both written out."""
    z = lambda row: b + sum(w[f] for f in row)
    loss = lambda x: math.log1p(math.exp(-x)) if x > -30 else -x
    mean = lambda rows, sign: sum(loss(sign * z(r)) for r in rows) / len(rows)
    return prior * mean(p, 1), mean(u, -1) - prior * mean(p, -1)


def plain_training(p, u, width, prior, steps):
    """The same descent with slopes taken from differences of the risk; also which steps went back."""
    x, back = [0.0] * width + [math.log(prior / (1 - prior))], []
    m, v = [0.0] * (width + 1), [0.0] * (width + 1)
    for step in range(1, steps + 1):
        negative = risk_parts(p, u, x[:-1], x[-1], prior)[1]
        back.append(negative < 0)

        def goal(y):
            pos, neg = risk_parts(p, u, y[:-1], y[-1], prior)
            return -neg if back[-1] else pos + neg

        slopes = []
        for i in range(width + 1):
            up, down = ([*x[:i], x[i] + d, *x[i + 1 :]] for d in (1e-5, -1e-5))
            slopes.append((goal(up) - goal(down)) / 2e-5)
        for i, g in enumerate(slopes):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            x[i] -= toxicity.RATE * (m[i] / (1 - 0.9**step)) / (math.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        shrink = toxicity.RATE * toxicity.LASSO
        x = [*(math.copysign(max(0.0, abs(c) - shrink), c) for c in x[:-1]), x[-1]]
    return x, back


@pytest.mark.parametrize(("positive", "unlabelled", "goes_back"), [
    ([[0], [0, 1], [0, 2]], [[0, 1], [0], [0, 2], [1], [2], [1, 2], []], False),  # they hold more of the positives' mark than the prior
    ([[0], [0, 1], [0]], [[1], [2], [2, 1], [2]], True),  # no unlabelled row looks toxic, so the negatives' part falls below zero
])
def test_toxicity_training_follows_the_risk(monkeypatch, positive, unlabelled, goes_back):
    steps = 40
    monkeypatch.setattr(toxicity, "STEPS", steps)
    want, back = plain_training(positive, unlabelled, 3, 0.3, steps)
    w, b = toxicity.train(positive, unlabelled, 3, 0.3)
    assert any(back) == goes_back
    assert np.allclose([*w, b], want, atol=1e-3)


def test_toxicity_with_small_samples(spark):
    """Bounds below the input's size: the sampled fit still tells the classes apart."""
    rows, labels, bad = toxic_corpus()
    docs = make_docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab, max_positive=40, max_unlabelled=200, max_features=50)
    assert model and len(model.weights) <= 50
    got = {r["rec"]["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[d] >= 0.5 for d in bad) >= 0.8 * len(bad)
    assert sum(s >= 0.5 for d, s in got.items() if d not in bad) <= 0.1 * len(rows)
