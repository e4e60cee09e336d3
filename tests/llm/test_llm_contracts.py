"""The queries of the contracts against brute force, on documents with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
import xxhash

from cairn.llm import catalog

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run(spark, name, sf_dir):
    return [r.asDict() for r in catalog.QUERIES[name](spark, sf_dir).collect()]


def bag(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def held_out(key, n, r):
    return key is not None and zlib.crc32(str(key).encode()) % n == r


def benchmark(spark, sf_dir):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


def test_op1_decontamination(spark, sf_dir, plain_rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in benchmark(spark, sf_dir):
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    expected = Counter()
    for key, text in plain_rows:
        w, hit, items = words(text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    items |= owners
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        expected[key, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert bag(run(spark, "op1_benchmark_decontamination", sf_dir), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected


def test_op2_repeats(spark, sf_dir, plain_rows):
    rank = lambda k: -(1 << 63) if k is None else k
    first = {}
    texts = [(rank(k), k, (t or "").encode()) for k, t in plain_rows]
    for r, _, b in texts:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(r, first.get(b[s : s + 50], r))
    expected = Counter()
    for r, k, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < r:
                gone[s : s + 50] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        expected[k, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()] += 1
    assert bag(run(spark, "op2_suffix_dedup", sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


@pytest.mark.parametrize(("name", "threshold"), [("op3_toxicity", 0.3), ("op5_quality_classifier", 0.7)])
def test_scores(spark, sf_dir, plain_rows, name, threshold):
    rows = run(spark, name, sf_dir)
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in plain_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    assert all(r["held_out"] is held_out(r["doc_id"], 4, 2) for r in rows)
    by_text = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            by_text[dict(plain_rows)[r["doc_id"]] if r["doc_id"] != 5 else r["score"]].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())  # equal texts score alike


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op4_near_duplicates(spark, sf_dir, plain_rows):
    prints = [(k, fingerprint(t)) for k, t in plain_rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    expected = Counter((k, f"{f:016x}", least.get(find(i))) for i, (k, f) in enumerate(prints))
    assert bag(run(spark, "op4_simhash_near_dedup", sf_dir), "doc_id", "fingerprint", "component_id") == expected


def slow_digest(text):
    """The quartile digest, triplet by triplet."""
    spread = np.random.default_rng(20).integers(0, 1 << 16, (3, 256), dtype=np.uint16).astype(int)
    b, counts = text.encode(), [0] * 128
    for i in range(len(b) - 4):
        for k, (x, y, z) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))):
            counts[((spread[0][b[i + x]] + spread[1][b[i + y]] * (2 * k + 1) + spread[2][b[i + z]]) & 0xFFFF) >> 9] += 1
    q1, q2, q3 = (sorted(counts)[n] for n in (31, 63, 95))
    length = min(255, int(2 * math.log(len(b)) / math.log(1.5))) if len(b) > 1 else 0
    ratios = (min(15, 16 * q1 // q3), min(15, 16 * q2 // q3)) if q3 else (0, 0)
    return hashlib.md5(b).digest()[0], length, ratios, [(c > q1) + (c > q2) + (c > q3) for c in counts]


def in_hex(d):
    body = [d[3][i] << 6 | d[3][i + 1] << 4 | d[3][i + 2] << 2 | d[3][i + 3] for i in range(0, 128, 4)]
    return bytes([d[0], d[1], d[2][0] << 4 | d[2][1], *body]).hex()


def slow_likeness(a, b):
    apart = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(a[3], b[3], strict=True))
    apart += sum(abs(x - y) for x, y in zip(a[2], b[2], strict=True)) + 2 * min(24, abs(a[1] - b[1])) + (a[0] != b[0])
    return round(max(0.0, 1 - apart / 300), 9)


def test_op6_digests(spark, sf_dir, plain_rows, ordered_rows):
    rows = run(spark, "op6_quartile_digest", sf_dir)
    expected = Counter()
    for i, (some, k, t) in enumerate(ordered_rows):
        half, following = len(t) // 2, ordered_rows[(i + 1) % len(ordered_rows)][2]
        edited = t[: len(t) - half] + following[:half]
        own, other, after = slow_digest(t), slow_digest(edited), slow_digest(following)
        expected[k if some else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), in_hex(own), in_hex(other), slow_likeness(own, other), slow_likeness(own, after)] += 1
    for r in rows:
        r |= {"near_edited": round(r["near_edited"], 9), "near_next": round(r["near_next"], 9)}
    assert bag(rows, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == expected
    prints = defaultdict(set)
    for r in rows:
        if r["doc_id"] not in (None, 5):
            prints[dict(plain_rows)[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_op7_tokens(spark, sf_dir, ordered_rows):
    from tokenizers import Tokenizer

    from cairn.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary())
    expected, start = Counter(), 0
    for some, k, x in ordered_rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4")
        expected[k if some else None, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert bag(run(spark, "op7_wavelet_token_shards", sf_dir), "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_op8_scores(spark, sf_dir, plain_rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    counts, ends = Counter(), 0
    for k, t in plain_rows:
        if not held_out(k, 10, 0):
            counts.update(words(t))
            ends += 1
    n, v = counts.total() + ends, len(counts) + 1
    whole = math.log10(n + 0.1 * (v + 1))
    expected = Counter()
    for k, t in plain_rows:
        w = words(t)
        base = sum(math.log10(counts[x] + 0.1) - whole for x in w) + math.log10(ends + 0.1) - whole
        expected[k, held_out(k, 10, 0), len(w) + 1, sum(x in counts for x in w) + 1, n, round(base, 6)] += 1
    rows = run(spark, "op8_lattice_scoring", sf_dir)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def slow_lattice(pieces, word):
    """(probability of all segmentations, {piece: expected uses}) of a word, by its paths' sums."""
    s, n = "▁" + word, len(word) + 1
    arcs = []
    for i in range(n):
        for j in range(i + 1, min(n, i + pieces["longest"]) + 1):
            if (p := pieces["known"].get(s[i:j])) is not None:
                arcs.append((i, j, pieces["p"][p], (p,)))
            elif j == i + 1:
                own = tuple(pieces["bytes"] + b for b in s[i].encode())
                arcs.append((i, j, math.prod((pieces["p"][x] for x in own), start=Decimal(1)), own))
    ahead, behind = [Decimal(1)] + [Decimal(0)] * n, [Decimal(0)] * n + [Decimal(1)]
    for i, j, p, _ in sorted(arcs):
        ahead[j] += ahead[i] * p
    for i, j, p, _ in sorted(arcs, reverse=True):
        behind[i] += p * behind[j]
    uses = Counter()
    for i, j, p, own in arcs:
        for x in own:
            uses[x] += ahead[i] * p * behind[j] / ahead[n]
    return ahead[n], uses


def test_op8_scores_by_all_segmentations(spark, sf_dir):
    """``score`` and ``lattice_score`` from the definitions, a word at a time."""
    import sentencepiece

    from cairn.llm.scoring import vocabulary

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    learned = [(words(t), g) for k, t, g in rows if not held_out(k, 10, 0)]
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    best = sorted(range(len(plain)), key=lambda i: -model.get_score(plain[i]))
    rank = {i: r for r, i in enumerate(best)}
    prior = np.array([1 / (rank[i] + 2.7) for i in range(len(plain))] + [1 / (len(plain) + 2.7)] * 256 + [1 / 2.7])
    prior /= prior.sum()
    known = {model.id_to_piece(i): n for n, i in enumerate(plain)}
    pieces = {"known": known, "longest": max(map(len, known)), "bytes": len(plain), "p": [*map(Decimal, prior.tolist())]}
    types = {w for ws, _ in learned for w in ws}
    for _ in range(2):
        uses = np.zeros(len(prior))
        for w in types:
            for x, n in slow_lattice(pieces, w)[1].items():
                uses[x] += float(n)
        p = uses + 0.1 * len(prior) * prior
        pieces["p"] = [*map(Decimal, (p / p.sum()).tolist())]
    end = pieces["p"][-1]
    groups = [g for g, _ in sorted(Counter(g for _, g in learned if g).items(), key=lambda x: (-x[1], x[0]))]
    counts, n_docs = defaultdict(Counter), Counter()
    for ws, g in learned:
        k = groups.index(g) if g else len(groups)
        counts[k].update(ws)
        n_docs[k] += 1
    memo = {}
    expected = Counter()
    for key, text, _ in rows:
        for w in words(text):
            memo[w] = memo.get(w) or slow_lattice(pieces, w)[0]
        lattice = float(sum(memo[w].log10() for w in words(text)) + end.log10())
        ways = []
        for k, n in n_docs.items():
            total = counts[k].total() + n
            rest = Decimal(0.75) * (len(counts[k]) + 1) / total
            part = lambda c, q: Decimal(max(c - 0.75, 0)) / total + rest * q  # noqa: B023, E731
            ways.append(math.log10(n / n_docs.total()) + float(sum(part(counts[k][w], memo[w]).log10() for w in words(text)) + part(n, end).log10()))
        top = max(ways)
        expected[key, round(top + math.log10(sum(10 ** (x - top) for x in ways)), 4), round(lattice, 4)] += 1
    found = run(spark, "op8_lattice_scoring", sf_dir)
    assert Counter((r["doc_id"], round(r["score"], 4), round(r["lattice_score"], 4)) for r in found) == expected


def test_op9_mixing(spark, sf_dir, plain_rows):
    rows = run(spark, "op9_source_mixing", sf_dir)
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in plain_rows)
    assert bag(rows, "doc_id", "size") == Counter((k, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t in plain_rows)
    total = sum(r["size"] for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source_size"], r["target"]].append(r)
    assert math.isclose(sum(t for _, t in by_source), 1.5 * total, rel_tol=1e-9)
    longest = max(r["size"] for r in rows)
    for (size, target), part in by_source.items():
        assert sum(r["size"] for r in part) == size and target <= 2 * size + 1e-9
        assert abs(sum(r["taken"] for r in part) - target) <= 2 * longest
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sum(r["taken"] for r in rows) <= 1.5 * total
    assert bag(run(spark, "op9_source_mixing", sf_dir), "doc_id", "taken") == bag(rows, "doc_id", "taken")


def test_op10_languages(spark, sf_dir):
    rows = run(spark, "op10_language_id", sf_dir)
    assert Counter(r["page_id"] for r in rows) == Counter([1, 2, 3, 4, 4, None])
    assert all(r["lang"] in ("en", "fr", "de") and 0 < r["confidence"] <= 1 for r in rows)
    assert next(r for r in rows if r["page_id"] == 1)["declared"] == "fr"


def test_op10_accuracy(spark, tmp_path):
    """Documents as pages of hosts: half of them learned from, the language of the others told from the evidence."""
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").where("lang is not null and text is not null")
    docs.where("doc_id % 2 = 0").write.parquet(f"{tmp_path}/documents.parquet")
    pages = docs.where("doc_id % 2 = 1").selectExpr(
        "doc_id as page_id", "concat('https://', source, '.example.', if(doc_id % 4 = 1, lang, 'org'), '/', doc_id) as url",
        "concat('<html', if(doc_id % 3 = 0, concat(' lang=\"', lang, '\"'), if(doc_id % 9 = 1, ' lang=\"en\"', '')), '><body><p>', text, '</p></body></html>') as html",
    )
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalog.QUERIES["op10_language_id"](spark, str(tmp_path)).join(docs.selectExpr("doc_id as page_id", "lang as said"), "page_id").collect()
    assert len(rows) == docs.where("doc_id % 2 = 1").count()
    assert sum(r["lang"] == r["said"] for r in rows) / len(rows) >= 0.95


def test_op10_fuses_by_bayes(spark, sf_dir):
    """The posteriors of the fixture's pages from the definitions, page by page."""
    from cairn.llm import language

    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    n = len(model.names)
    page_bytes = [(h or "").encode() for _, _, h in pages]
    text = [model.likelihoods(language.visible(h)) for h in page_bytes]
    declared = [language.declared(h) or "" for h in page_bytes]
    host = [language.host_of(u or "") for _, u, _ in pages]
    belief = [soft(x + np.log(np.maximum(model.share, 1e-9))) for x in text]
    by_host = {h: sum(b for b, x in zip(belief, host, strict=True) if x == h) for h in set(host)}
    whole = sum(by_host.values())
    above = {h: (whole + 1) / (whole.sum() + n) for h in by_host}
    for level in (1, 2, 3):
        zone = {h: ".".join(h.split(".")[-level:]) for h in by_host}
        sums = {z: sum(c for h, c in by_host.items() if zone[h] == z) for z in zone.values()}
        above = {h: (sums[zone[h]] + above[h] * 4) / (sums[zone[h]].sum() + 4) for h in by_host}
    says = {d: sum(b for b, x in zip(belief, declared, strict=True) if x == d) for d in set(declared)}
    total = sum(says.values())
    expected = Counter()
    for (key, _, _), x, d, h, b in zip(pages, text, declared, host, belief, strict=True):
        share = (says[d].sum() + 1) / (total.sum() + len(says))
        others = np.maximum(by_host[h] - b, 0)
        posterior = soft(x + np.log((says[d] + share) / (total + 1)) + np.log((others + above[h] * 4) / (others.sum() + 4)))
        expected[key, model.names[int(posterior.argmax())], round(float(posterior.max()), 6)] += 1
    found = run(spark, "op10_language_id", sf_dir)
    assert Counter((r["page_id"], r["lang"], round(r["confidence"], 6)) for r in found) == expected


def test_op10_many_languages(spark):
    """More languages than any list has: each is told by its own letters, and ties go to the first by code."""
    from cairn.llm import language

    codes = [a + b for a in "abcdefghij" for b in "abcdefghij"]
    docs = [(i, f"{c}{c}x {c}q{c} z{c}" * 3, c.upper() + "-XX" if i % 2 else c) for i, c in enumerate(codes)] + [(1000, "no code", "english"), (1001, None, "aa")]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.names == sorted(codes)
    pages = spark.createDataFrame([(i, None, f"<p>{t}") for i, t, c in docs[:100]] + [(500, None, None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in language.identify(pages, model).collect()}
    assert sum(found[i]["lang"] == c for i, c in enumerate(codes)) >= 99
    assert found[500]["lang"] == "aa"  # the most frequent


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_empty_tables(spark, tmp_path, sf_dir, name):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert run(spark, name, str(tmp_path)) == []


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_sql(spark, name):
    """The SQL of a contract on the smallest of the driver's tables."""
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    result = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in result.description]
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    expected = Counter(tuple(tidy(v) for v in row) for row in result.fetchall())
    found = catalog.QUERIES[name](spark, at)
    assert sorted(found.columns) == sorted(names)
    assert Counter(tuple(tidy(r[n]) for n in names) for r in found.collect()) == expected
