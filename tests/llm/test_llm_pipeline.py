"""Every stage of the pipeline against brute force: the whole rows that it keeps."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import turn
from test_llm_contracts import LOWER, fingerprint

import corpus_pipeline
from cairn.llm import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def toxic_go(spark, rows, sf_dir):
    """The machine's score, term by term and pair by pair."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.trained_on(spark, df, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    place = {int(b): i for i, b in enumerate(model.buckets)}

    def score(text):
        terms = {x for w in alnum(text) for x in (zlib.crc32(w.encode()) % (1 << 20), zlib.crc32(b"^" + w.encode()[:5]) % (1 << 20))}
        at = sorted(place[t] for t in terms if t in place)
        raw = model.bias + sum(model.weights[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for i in at for j in at if i < j)
        return 1 / (1 + math.exp(-max(-30, min(30, raw))))

    return [r for r in rows if score(r[1]) < 0.3]


def one_of_each_class(spark, rows, sf_dir):
    prints = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0, signed(prints[i]), hashlib.md5((rows[i][1] or "").encode()).hexdigest(), rows[i][1] is None)
    return [rows[min(g, key=key)] for g in groups.values()]


def contaminated_go(spark, rows, sf_dir):
    windows = set()
    for (text,) in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect():
        w = alnum(text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    out = []
    for r in rows:
        w, hit = alnum(r[1]), set()
        for x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def mix(spark, rows, sf_dir):
    """Targets by filling, queues in the order of hashed doc_ids, finish times in order until the budget ends."""
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(spaced(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sizes.total(), set(names), {}
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * sizes[s] - 1e-9]
        if not over:
            for s in free:
                target[s] = left * weight[s] / sum(weight[x] for x in free)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left, free = left - sum(target[s] for s in over), free - set(over)
    times = []
    for s in names:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"0:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, len(spaced(r[1]))))
        done = 0
        for r in own:
            done += len(spaced(r[1]))
            if target[s] > 0:
                at = hashlib.md5(f"0:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0]
                times += [(done / target[s], *at, len(spaced(r[1])), r), ((done + sizes[s]) / target[s], *at, len(spaced(r[1])), r)]
    budget, spent, last = 3 * sizes.total() // 2, 0, None
    for t in sorted((t for t in times if t[3]), key=lambda t: t[:3]):
        if spent + t[3] > budget:
            break
        spent, last = spent + t[3], t[:3]
    return [t[4] for t in times if last and t[:3] <= last]


BRUTE = {"toxicity": toxic_go, "near_duplicates": one_of_each_class, "decontamination": contaminated_go, "mixing": mix}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, rows that it got, rows that it kept) of each stage that keeps documents."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        kept = stage(spark, docs, sf_dir)
        assert kept.schema == docs.schema, name
        out.append((name, before, [tuple(r) for r in kept.select(*COLUMNS).collect()]))
        docs = spark.createDataFrame(out[-1][2], docs.schema)
    return out, docs


@pytest.mark.parametrize("name", list(BRUTE))
def test_stage(spark, sf_dir, stages, name):
    _, before, kept = next(s for s in stages[0] if s[0] == name)
    expected = BRUTE[name](spark, before, sf_dir)
    assert kept and Counter(kept) == Counter(expected) != Counter(before)


@pytest.mark.parametrize("name", list(BRUTE))
def test_stage_on_all_documents(spark, sf_dir, name):
    """Each stage also on the documents that no stage has been over."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert Counter(tuple(r) for r in kept.select(*COLUMNS).collect()) == Counter(BRUTE[name](spark, before, sf_dir))


def test_token_stage(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    from cairn.llm import tokens

    docs, expected, start = stages[1], Counter(), 0
    whole = Tokenizer.from_file(tokens.vocabulary())
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, turn(r["text"]))):
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected[r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    found = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found.collect()) == expected


def test_stages_keep_clashing_columns(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.schema == docs.schema, name
        rows = kept.collect()
        assert rows and {x for r in rows for x in r[5:]} == {"clash"}, name


def test_pipeline_on_nothing(spark, empty, sf_dir):
    table = empty.select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, sf_dir).count() == 0, name


def test_token_files_of_the_run_stay(spark, sf_dir, tmp_path):
    from cairn import storage
    from cairn.llm import tokens

    at = f"{tmp_path}/out"
    rows = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir, at).collect())
    storage.forget()
    assert rows and Counter(tuple(r) for r in tokens.read_shards(spark.read.parquet(at)).collect()) == rows
