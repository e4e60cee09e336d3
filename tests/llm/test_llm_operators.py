"""The operators' own interfaces: whole tables in, whole tables out."""

import math
import random
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common, components, decontaminate, digest, language, lattice, mixing, quality, scoring, simhash, substrings, suffixes, tokens, toxicity, wavelet


def test_extra_columns_stay(docs, spark, sf_dir):
    """Columns that are named like an operator's own are what they were."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for out in (decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, longest=20), decontaminate.decontaminate(docs, bench, block_words=30), simhash.deduplicate(docs), mixing.mixed(docs)):
        assert out.schema == docs.schema
        rows = out.collect()
        assert rows and {x for r in rows for x in r[5:]} == {"clash"}


def test_extra_columns_are_no_hindrance(docs, spark, sf_dir):
    """Operators that give a table of their own take the same rows with and without them."""
    bench, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bag = lambda df: Counter(str(tuple(r)) for r in df.collect())
    model = toxicity.trained_on(spark, plain, labels)
    for f in (
        lambda d: decontaminate.find(d, bench, keep=["doc_id"]).selectExpr("doc_id", "n_words", "n_hit", "items", "hit_spans"),
        lambda d: substrings.remove_repeats(d),
        lambda d: toxicity.scored(d, model).select("doc_id", "score"),
        lambda d: simhash.classes(d),
        lambda d: quality.described(d).select("doc_id", "stats"),
        lambda d: digest.compared(d),
        lambda d: tokens.read_shards(tokens.write_shards(d, tokens.vocabulary())).drop("shard"),
        lambda d: scoring.score(d, scoring.vocabulary(), scoring.held_out()).selectExpr("doc_id", "n_tokens", "round(score, 6)"),
        lambda d: mixing.mix(d),
    ):
        rows = bag(f(docs))
        assert rows and rows == bag(f(plain))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumns({n: F.lit("clash") for n in ("lang", "host", "declared", "counts", "above", "belief", "__url", "__html", "__text", "says")})
    assert language.identify(pages, language.train(docs)).count() == 6


def test_one_row_of_each_class_stays(spark):
    """Repeated doc_ids with different texts, rows without a doc_id, rows that repeat."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "an other text that nobody else has"
    rows = [(2, a, "z"), (5, a, "y"), (5, b, "x"), (5, b, "w"), (None, a, "v"), (None, c, "u"), (None, c, "t"), (7, None, "s"), (8, "", "r"), (7, "", "q"), (1, c + " again and again in other words", "p")]
    for turn in range(3):
        kept = simhash.deduplicate(spark.createDataFrame(rows[turn:] + rows[:turn], "doc_id long, text string, extra string").repartition(2)).collect()
        assert Counter(tuple(r) for r in kept) == Counter([(2, a, "z"), (5, b, "w"), (None, c, "t"), (7, "", "q"), (1, c + " again and again in other words", "p")])


def test_several_automata(spark, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = lambda block: Counter((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontaminate.find(docs, bench, block_words=block, keep=["doc_id"]).collect())
    assert rows(100_000) == rows(30)


def test_spans_are_cut(spark, sf_dir):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")
    text = "start " * 300 + "W0, " + " ".join(f"w{i}" for i in range(1, 13)) + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut = decontaminate.decontaminate(docs, bench, longest=12).first()["text"]
    assert cut == "start " * 300 + " end"


def test_suffix_automaton_finds_all_windows():
    rng = random.Random(3)
    items = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = decontaminate.SuffixAutomaton(items, 5)
    for _ in range(60):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 30))]
        hit, found = np.zeros(len(words), bool), set()
        for n, item in enumerate(items):
            size = min(5, len(item))
            for window in {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}:
                for i in range(len(words) - size + 1):
                    if tuple(words[i : i + size]) == window:
                        hit[i : i + size] = True
                        found.add(n)
        own_hit, own_found = automaton.match(words)
        assert (own_hit == hit).all() and own_found == found


def test_suffix_order():
    rng = random.Random(1)
    for t in range(80):
        data = bytes(rng.choice(b"ab" if t % 2 else b"a\x00b") for _ in range(rng.randint(0, 60)))
        assert suffixes.suffix_array(data, rng.choice([8, 16])).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_runs_of_long_texts(spark):
    """A text of several segments, with a repeat across their border."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(substrings.SEGMENT + 4000))
    again = text[substrings.SEGMENT - 300 : substrings.SEGMENT + 300]
    docs = spark.createDataFrame([(1, text), (2, "x" + again + "y")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substrings.remove_repeats(docs, with_text=True).collect()}
    assert rows[1]["n_removed"] == 0 and rows[2]["n_removed"] == 600 and bytes(rows[2]["kept"]) == b"xy"


def connected(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[find(x)] = find(y)
    return find


def test_grid_finds_every_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, d, replace=False))) for b in base for d in (1, 3, 4, 5)]
    prints = np.unique(np.concatenate((base, np.array(near, dtype=np.uint64))))
    cells, who = simhash.cells_of(prints)
    order = np.argsort(cells, kind="stable")
    a, b = simhash.links_in(cells[order], who[order])
    expected = {(int(x), int(y)) for i, x in enumerate(prints) for y in prints[i + 1 :] if (int(x) ^ int(y)).bit_count() <= 4}
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} <= expected
    find = connected(zip(a.tolist(), b.tolist(), strict=True))
    assert all(find(x) == find(y) for x, y in expected)


def test_full_cells_lose_no_link():
    """One cell of many fingerprints, dealt by fifths, has the same components as pair by pair."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 12, 300, dtype=np.uint64) * np.uint64(0x10001000100041)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, 4, replace=False))) for b in base for _ in range(3)]
    prints = np.unique(np.concatenate((base, np.array(near, dtype=np.uint64))))
    cells = np.zeros(len(prints), dtype=np.int64)
    every = [(int(x), int(y)) for i, x in enumerate(prints) for y in prints[i + 1 :] if (int(x) ^ int(y)).bit_count() <= 4]
    for deal in (100, 10_000):
        a, b = simhash.links_in(cells, prints, deal=deal)
        assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} <= set(every)
        find = connected(zip(a.tolist(), b.tolist(), strict=True))
        assert all(find(x) == find(y) for x, y in every)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (100, 300), (7, 7)]
    found = {r[0]: r[1] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100} or found == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1000, 7), (3000, 50_000), (500, 1), (wavelet.BLOCK, 3), (2 * wavelet.BLOCK + 77, 70_000)):
        numbers = rng.integers(0, top, n).astype(np.uint32)
        m = wavelet.WaveletMatrix(wavelet.build(numbers))
        assert (m.decode() == numbers).all()
        assert m.count(top + 1) == 0 and not len(m.positions(top + 1))
        for i in range(0, n, max(37, n // 50)):
            value = int(numbers[i])
            places = np.flatnonzero(numbers == value)
            assert m.access(i) == value and m.count(value) == len(places) and m.rank(value, i) == int((numbers[:i] == value).sum())
            assert m.positions(value).tolist() == places.tolist()
            assert [m.select(value, k) for k in (0, len(places) - 1, len(places))] == [int(places[0]), int(places[-1]), -1]
        assert m.count(60_000) == 0


def test_shards_are_cut_and_counted(spark, docs):
    whole = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in tokens.read_shards(tokens.write_shards(docs, tokens.vocabulary())).collect()}
    shards = tokens.write_shards(docs, tokens.vocabulary(), shard_ids=100)
    assert shards.count() > 10
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in tokens.read_shards(shards).collect()} == whole


def test_token_files_stay_and_are_searched(spark, docs, tmp_path, ordered_rows):
    """Files in a named folder, opened by a session that did not write them; counts, places and ids without decoding."""
    from cairn import storage

    at = f"{tmp_path}/tokens"
    tokens.write_shards(docs, tokens.vocabulary(), output=at, shard_ids=300)
    storage.forget()  # what the driver's end does
    shards = spark.newSession().read.parquet(at)
    assert shards.count() > 5
    encode, ids, owner = tokens.Encoder(tokens.vocabulary()).encode, [], []
    for some, key, text in ordered_rows:
        own = [*encode(text.encode()).tolist(), 1]
        owner += [(key if some else None, i) for i in range(len(own))]
        ids += own
    common = [x for x, _ in Counter(ids).most_common(3)] + [48_000, 1]
    assert {r["id"]: r["n"] for r in tokens.count_ids(shards, common).collect()} == {x: ids.count(x) for x in common}
    found = Counter((r["id"], r["position"], r["doc_id"], r["place"]) for r in tokens.locate_ids(shards, common).collect())
    assert found == Counter((x, i, *owner[i]) for i, x in enumerate(ids) if x in common for _ in range(common.count(x)))
    asked = list(range(-3, len(ids) + 3, 17))
    assert {r["position"]: r["id"] for r in tokens.ids_at(shards, spark.createDataFrame([(i,) for i in asked], "position long")).collect()} == {i: ids[i] for i in asked if 0 <= i < len(ids)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_have_the_tokenizers_ids(name, plain_rows):
    """Of a tokenizer that keeps white space and case as well."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, own = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = [t or "" for _, t in plain_rows] + ["Hello World, two  words", " İstanbul ǅ\u0301 CAFÉ's <|endoftext|>x"]
    for t, ids in zip(texts, own.encode_batch([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_distinct_words_go_to_the_tokenizer_once():
    """A word of many texts, cases and marks is sent once, with nothing but a space between words."""
    own, sent = tokens.Encoder(tokens.vocabulary()), []
    bare = own.bare

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return bare.encode_batch_fast(texts, **how)

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(3, 9))) + "s" for _ in range(3000)]
    distinct = {w.lower() for w in words}
    texts = [" ".join(rng.choice((w, w.capitalize() if w.isascii() else w, w + ",", w + ".")) for w in words) for _ in range(5)]
    own.bare = Counted()
    found = own.encode_batch([t.encode() for t in texts])
    assert sum(map(len, sent)) < sum(len(w) + 1 for w in distinct) + 50
    for t, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("pieces", [2, 40, 10_000])
def test_any_table_of_pieces_gives_the_tokenizers_ids(pieces, monkeypatch):
    """Odd characters in any place, small tables and blocks of few texts."""
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 300)
    monkeypatch.setattr(tokens, "PASS", 7)
    rng, own = random.Random(pieces), tokens.Encoder(tokens.vocabulary(), pieces)
    odd = [*map(chr, range(0x250)), *"\u0300\u0301\u0307\u0340\u0345\u0378\u1e9e\u2028\u200b\u3000\ufeff\ufffdΣςσАд中文٣Ⅷ²\U0001f600", "'s", "'LL", "<|endoftext|>", "<|startoftext|>,", "word", "Word.", "two", "THE,", "the"]
    texts = ["", " ", "  a "] + ["".join(rng.choice(odd) + rng.choice(("", "", " ", "\n", ".", "a")) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for start in range(0, len(texts), 50):
        some = texts[start : start + 50]
        for t, ids in zip(some, own.encode_batch([t.encode() for t in some]), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_long_texts(spark, sf_dir):
    """Texts of megabytes beside short ones go through every operator as whole texts."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    item = " ".join(words[:15])
    rows = [(1, long, "en", "a"), (2, long + " " + item, "en", "a"), (3, item, "en", "b"), (4, "x" * 3_000_000, "en", "b"), (5, "short", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find(docs, bench, keep=["doc_id"]).collect()}
    assert [found[k]["n_words"] for k in (1, 2, 3, 4, 5)] == [400_000, 400_015, 15, 1, 1] and [found[k]["n_hit"] for k in (1, 2, 3)] == [0, 15, 15]
    gone = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert gone[1] == 0 and gone[2] == len(long) and gone[4] == 0
    classes = {r["doc_id"]: r["component_id"] for r in simhash.classes(docs).collect()}
    assert classes[2] == 1 and classes[4] == 4
    for out in (toxicity.scored(docs, toxicity.fit([], np.zeros(0))), quality.described(docs), digest.compared(docs), mixing.mix(docs), scoring.score(docs, scoring.vocabulary(), scoring.held_out())):
        assert out.count() == 5
    read = {r["doc_id"]: r["n_tokens"] for r in tokens.read_shards(tokens.write_shards(docs, tokens.vocabulary())).collect()}
    assert read[2] - read[1] == len(tokens.Encoder(tokens.vocabulary()).encode(item.encode()))
    pages = docs.selectExpr("doc_id as page_id", "'' as url", "concat('<p>', text) as html")
    assert language.identify(pages, language.train(docs)).count() == 5


def test_batches_are_bounded_by_bytes(spark):
    """What the operators rely on for long texts: Arrow batches have a bound in bytes, of Spark's own."""
    bound = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))
    rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) <= bound + 1_100_000


def test_a_text_that_goes_along_is_sent_once(spark, docs):
    """A worker's batches have the columns that are kept and no second copy of the text."""
    seen = lambda: lambda texts, batch: [[batch.num_columns] * len(texts), texts]
    fields = {"columns": (T.LongType(), pa.int64()), "bytes": (T.BinaryType(), pa.binary())}
    for keep, n in ((None, len(docs.columns)), (["text"], 1), (["doc_id"], 2), ([], 1)):
        out = common.annotate(docs, seen, fields, keep=keep)
        assert out.columns == [*(docs.columns if keep is None else keep), *fields]
        rows = out.collect()
        assert {r["columns"] for r in rows} == {n}
        assert Counter(bytes(r["bytes"]) for r in rows) == Counter((r["text"] or "").encode() for r in docs.collect())
        if "text" in out.columns:
            assert all((r["text"] or "").encode() == r["bytes"] for r in rows) and any(r["text"] is None for r in rows)
    raw = docs.select(F.col("text").cast("binary").alias("text"))
    assert {r["columns"] for r in common.annotate(raw, seen, fields).collect()} == {2}


def test_a_worker_gives_back_what_another_operator_kept(docs, monkeypatch):
    """Workers outlive a stage: the tables of pieces would stay beside all that later stages hold."""
    passes, encoder = [], tokens.encoder(tokens.vocabulary())
    assert tokens.encoder(tokens.vocabulary()) is encoder
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: passes.append(run))
    common.annotate(docs, lambda: lambda texts, _: [[len(t) for t in texts]], {"n": (T.LongType(), pa.int64())}, keep=["doc_id"])
    here, encoder = weakref.ref(encoder), None
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "__text": ["é".encode(), None]})
    assert [b.to_pydict() for b in passes[0](iter([batch]))] == [{"doc_id": [1, 2], "n": [2, 0]}]
    assert here() is None


def test_session_is_left_as_it_was(spark, docs, sf_dir):
    from cairn.llm import catalog

    before = dict(spark.conf.getAll)
    for name in ("op1_benchmark_decontamination", "op5_quality_classifier", "op7_wavelet_token_shards"):
        catalog.QUERIES[name](spark, sf_dir)
    assert dict(spark.conf.getAll) == before


def test_machine_scores_by_all_pairs():
    """The score from the definition: bias, weights, and each pair's product."""
    rng = np.random.default_rng(3)
    model = toxicity.Machine(np.arange(10, 40, dtype=np.int32), -0.3, rng.normal(0, 0.5, 30), rng.normal(0, 0.5, (30, 4)))
    for _ in range(20):
        terms = np.unique(rng.integers(0, 50, 12)).astype(np.int32)
        at = [int(t) - 10 for t in terms if 10 <= t < 40]
        raw = -0.3 + sum(model.weights[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for i in at for j in at if i < j)
        assert math.isclose(model.score(model.features(terms)), 1 / (1 + math.exp(-raw)), rel_tol=1e-9)


def test_all_telling_terms_are_learned():
    """However many there are: no list has an end."""
    rows, labels = [], []
    for i in range(12_000):
        y = i % 2
        rows.append(np.unique(np.array([100 + 6000 * y + (i // 2 + k) % 6000 for k in range(40)], dtype=np.int32)))
        labels.append(float(y))
    assert len(toxicity._informative(rows, np.array(labels))) == 12_000


def test_ridge_is_the_least_squares_solution(spark):
    """Coefficients and scores from sums by partition against one matrix of all rows."""
    rng = np.random.default_rng(6)
    stats = rng.normal(0, 1, (300, len(quality.STATISTICS)))
    y = (stats[:, 0] + 0.3 * rng.normal(0, 1, 300) > 0).astype(float)
    rows = spark.createDataFrame([(x.tolist(), int(v)) for x, v in zip(stats, y, strict=True)], "stats array<double>, label int").repartition(5)
    model = quality.train(rows, cosines=32)
    again = quality.Ridge(stats.mean(axis=0), stats.std(axis=0), 32)
    z = np.concatenate((np.cos((np.clip((stats - stats.mean(axis=0)) / stats.std(axis=0), -6, 6)) @ again.turn + again.phase) * (2 / 32) ** 0.5, np.ones((300, 1))), axis=1)
    penalty = quality.RIDGE * 300 / 33
    beta = np.linalg.solve(z.T @ z + penalty * np.diag([1.0] * 32 + [0.0]), z.T @ y)
    assert np.allclose(model.beta, beta, atol=1e-6)
    raw, bins = z @ beta, defaultdict(list)
    for r, v in zip(raw, y, strict=True):
        bins[min(999, max(0, int((r + 0.5) / 2 * 1000)))].append((r, v))
    keys = sorted(bins)
    share = quality.isotonic(np.array([np.mean([v for _, v in bins[k]]) for k in keys]), np.array([float(len(bins[k])) for k in keys]))
    share = np.clip(share * 0.998 + 0.002 * np.linspace(0, 1, len(keys)), 0, 1)
    expected = np.clip(np.interp(raw, [np.mean([r for r, _ in bins[k]]) for k in keys], share), 0, 1)
    assert np.allclose(model.score(stats), expected, atol=1e-6)


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        terms = np.unique(np.concatenate(([11] if a else [], [22] if b else [], rng.integers(100, 130, 5))).astype(np.int32))
        rows.append(terms)
        labels.append(float(a and b))  # neither is toxic alone
    model = toxicity.fit(rows, np.array(labels), rounds=15)
    guessed = [model.score(model.features(r)) >= 0.5 for r in rows]
    assert np.mean(np.array(guessed) == (np.array(labels) > 0)) > 0.97


def test_models_without_labels():
    model = toxicity.fit([], np.zeros(0))
    assert model.score(model.features(np.array([1, 2], dtype=np.int32))) < 0.01
    ridge = quality.Ridge(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    assert ridge.score(np.array([quality.statistics(b"")])).tolist() == [0.5]


@pytest.mark.parametrize(("query", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op5_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    from cairn.llm import catalog

    at = "/root/testdata/sf0.01"
    rows = catalog.QUERIES[query](spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least


def test_isotonic():
    values, weights = np.array([0.2, 0.1, 0.4, 0.3, 0.9]), np.array([1.0, 3.0, 1.0, 1.0, 2.0])
    out = quality.isotonic(values, weights)
    assert np.allclose(out, [0.125, 0.125, 0.35, 0.35, 0.9])


def test_lattice_sums_all_segmentations():
    texts, p = ["▁", "a", "b", "ab", "▁a", "ba"], None
    p = np.concatenate((np.array([0.1, 0.2, 0.1, 0.2, 0.15, 0.05]), np.full(256, 0.1 / 256), [0.1]))
    grid = lattice.Lattice(texts, p)
    known = dict(zip(texts, p, strict=False))

    def total(s):
        return 1.0 if not s else sum(known[s[:n]] * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in known)

    words = ["a", "ab", "aba", "bab", "bbab"]
    assert np.allclose(grid.score(words), [math.log(total("▁" + w)) for w in words])
    counts = grid.expect(words, np.ones(len(words)))
    spelled = sum(c * len(t) for c, t in zip(counts, texts, strict=False))
    assert math.isclose(spelled, sum(len(w) + 1 for w in words), rel_tol=1e-9)
    assert math.isfinite(grid.score(["é" * 300])[0]) and grid.score(["é"])[0] < grid.score(["a"])[0]


def test_training_improves_likelihood(spark, docs):
    held = scoring.held_out()
    zero, two = (scoring.score(docs, scoring.vocabulary(), held, group=None, rounds=n).agg({"score": "sum"}).first()[0] for n in (0, 2))
    assert two > zero


def test_digests():
    a = b"The quick brown fox jumps over the lazy dog. " * 20
    near, far = a.replace(b"lazy", b"idle", 3), bytes(range(256)) * 4
    same, close, other = (digest.likeness(digest.digest(a), digest.digest(x)) for x in (a, near, far))
    assert same == 1 and 0.5 < close < 1 and other < close
    assert digest.difference(digest.digest(a), digest.digest(far)) == digest.difference(digest.digest(far), digest.digest(a))
    assert digest.edited("aéb".encode(), "ñx".encode()) == "aéñ".encode()


def test_mix_levels(spark):
    rows = [(i, "w " * (10 + i % 3), s) for i, s in enumerate(["a"] * 50 + ["b"] * 30 + ["c"] * 5 + [None] * 15)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slice_rows=7).collect()
    targets = {(r["source_size"], r["target"]) for r in out}
    sizes = sorted(s for s, _ in targets)
    whole = sum(sizes)
    assert math.isclose(sum(t for _, t in targets), 1.5 * whole)
    assert abs(sum(r["taken"] for r in out) - 1.5 * whole) <= 24


def test_language_evidence():
    page = b'<html lang="de"><head><style>x</style></head><body><nav>le la</nav>Wort &amp; Satz<script>if (a<b) {}</script> mehr</body>'
    assert language.declared(page) == "de" and language.visible(page).split() == [b"Wort", b"Satz", b"mehr"]
    assert language.visible(b"a <script> never closed") .split() == [b"a"]
    assert language.host_of("https://www.Example.COM:80/x") == "www.example.com" and language.host_of("http://[") == ""


def test_quality_score_of_a_row_is_the_same_in_any_batch():
    from cairn.llm.quality import STATISTICS, Ridge

    rng = np.random.default_rng(1)
    model = Ridge(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    model.beta = rng.normal(size=len(model.beta))
    row, found = rng.normal(size=len(STATISTICS)), set()
    for n in (1, 2, 3, 4, 7, 8, 16, 33):
        rows = rng.normal(size=(n, len(STATISTICS)))
        for i in range(n):
            found.add(float(model.raw(np.vstack((rows[:i], row, rows[i + 1 :])))[i]))
    assert len(found) == 1
