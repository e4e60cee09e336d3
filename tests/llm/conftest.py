"""Documents with every awkward case in them."""

import random

import pytest
from pyspark.sql import types as T

#: Names that operators use for columns of their own, here or in their results.
CLASHING = (
    "fp score items n_hit n_words hit_spans ids stats size taken turn shard share words target finish times queue slice row root first component_id digest kind data "
    "__text __doc_id __digest __id __source __times __turn __had_items __had_spans __clean __score __one __copy __cairn_text code place group chunk bucket shingle label held_out"
).split()

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in CLASHING],
    ]
)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to a in for is on that by this with you it not or be are from").strip() if rng.random() < 0.3 else "".join(rng.choice("abcdeéfghiÄß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(7)
    passage = sentence(rng, 40)
    texts = [sentence(rng, rng.randint(1, 120)) + (" vileword" if i % 5 == 0 else "") for i in range(40)]  # as the labels have it
    texts += [None, "", " \t\n ", "word", "two words", "x" * 30, "\x01\x7f  ", "é", "İ ǅ <|endoftext|> a'S", "same text here"]
    texts += ["same text here", texts[0], texts[0], texts[1] + " more", "Start " + texts[2], passage, "before " + passage + " after", passage.upper(), sentence(rng, 3000)]
    texts += [texts[3].replace("a", "o", 1), "ab" * 300, "a" * 200, sentence(rng, 12) + "\n" + passage]
    out = [(i, t, "en" if i % 3 else "fr", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], (5, "another text of the same id", "en", "s1", 3), (None, "without an id", None, None, None), (None, passage, "en", "s0", 1), (-4, passage, "de", "s2", 0)]
    return [(*r, *["clash"] * (len(SCHEMA) - 5)) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def turn(text: str | None) -> int:
    """The place of rows of one doc_id: the signed XXH64 of the text."""
    import xxhash

    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="session")
def ordered_rows():
    """(has a doc_id, doc_id or 0, text) in the order in which documents follow one another."""
    rows_in = [(r[0] is not None, r[0] or 0, r[1] or "") for r in rows()]
    return sorted(rows_in, key=lambda x: (x[0], x[1], turn(x[2])))


@pytest.fixture(scope="session")
def plain_rows():
    """(doc_id, text) of all documents."""
    return [(r[0], r[1]) for r in rows()]


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory, spark, docs):
    """A folder of tables like the driver's, with the awkward documents."""
    at = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(45)] + [(3, 1, 0), (None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    passage = next(r[1] for r in rows() if r[0] == -4)
    items = [(1, passage), (2, "the of"), (3, None), (4, ""), (10, passage), (5, " ".join(passage.split()[5:25]) + " tail tail tail"), (6, "word")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    pages = [(1, "https://www.a.example.com/x", '<html lang="fr"><body>le la les des une</body></html>'), (2, None, None), (3, "", ""), (4, "http://[bad", "<script>x"), (4, "http://[bad", "<script>x"), (None, "https://b.org", "<!-- a")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)
