"""Long lists, large mappings and sinks beside what they stand for; null and repeated keys; tasks that are lost."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from umbra import batch
from umbra.functions import scalars as S
from umbra.operators import entities as E
from umbra.operators import mask as M
from umbra.plans import samples
from umbra.sources import folder, office, ooxml
from umbra.sources.folder import write_folder

WORDS = ["a", "B", "ab", "Bed Rock", "bed", "(x)", "É", "e f g", "a-b", "rock, ab", "_a", "bedrock", "İx", "the long beginning one", "the long beginning two"]


def corpus(spark):
    r = random.Random(3)
    texts = [None, "", "BedRock bed  ROCK bedrocks", "İx bed a İX", "The long  Beginning ONE, the long beginning three"]
    texts += ["".join(r.choice(["a", "b", "B", " ", "\n", "bed", "rock", "(x)", "é", "e", "f", "g", "-", ",", "_", "　", "\x1c"]) for _ in range(r.randint(1, 60))) for _ in range(80)] + ["a b"] * 3
    # Keys that are null, shared, or both.
    return spark.createDataFrame([(r.choice([None, 1, i, i]), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("path", ["automaton", "join"])
def test_lists_of_any_length(spark, monkeypatch, path):
    docs, listed = corpus(spark), [(v, v) for v in WORDS] + [("bed", "again")]
    want = [rows(f(docs, listed)) for f in (lambda d, x: M.claims(d, x, use_regex=False), M.verify, M.items, M.leaks)]
    monkeypatch.setattr(E, "LITERAL", 2)
    if path == "join":
        monkeypatch.setattr(E, "AUTOMATON", 0)
    got = [rows(f(docs, listed)) for f in (lambda d, x: M.claims(d, x, use_regex=False), M.verify, M.items, M.leaks)]
    assert got == want and all(want)
    null = docs.where("doc_id is null")
    assert len(rows(M.verify(null, listed))) == null.where("text is not null").count() > 3


def test_null_keys_with_a_long_list(spark):
    docs = spark.createDataFrame([(None, "of Acme Ltd, and"), (None, "nothing"), (1, "Acme Ltd")], "doc_id long, text string")
    many = [("Acme Ltd", "Client")] + [(f"Other {i}", "Entity") for i in range(400)]
    assert sorted((r.doc_id or 0, r.n_leaks, r.clean) for r in M.verify(docs, many).collect()) == [(0, 0, True), (0, 1, False), (1, 1, False)]
    assert M.claims(docs, many, use_regex=False).count() == 2


def test_mappings_of_any_length(spark):
    """The index leaves out no pair: cascades into placeholders, originals without word characters, null texts, several texts a key."""
    r = random.Random(8)
    words = ["Acme", "Client", "A", "us", "café", "É", "x-y", "New York", "York", "Ltd.", "(b)", "$1"]
    items = [(k, i, w, r.choice(["Client", "Address"]), r.choice(["Client A", "Address", "York Ltd.", "café", "\\0 $1", "us"]), r.choice([True, None, False])) for k in (1, 2, 3) for i, w in enumerate(r.sample(words, 9))]
    reviewed = spark.createDataFrame(items, "doc_id long, seq long, text string, category string, placeholder string, include boolean")
    texts = [(r.choice([1, 2, 3, 4, None]), " ".join(r.choice([*words, "customer", "-", "b"]) for _ in range(r.randint(0, 12)))) for _ in range(120)] + [(1, None), (1, ""), (2, "us us"), (2, "us us")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want, got = M.apply(docs, reviewed), M.apply(docs, reviewed, many=True)
    assert rows(got) == rows(want) and want.where("changed").count() > 40
    assert got.columns == want.columns


def _rows(spark, n):
    return spark.range(n, numPartitions=4).select(F.concat(F.lit("d/f"), F.col("id").cast("string")).alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"), F.lit("").alias("section"), F.to_json(F.struct("id")).alias("value"))


def test_folder_is_written_in_order(spark, tmp_path):
    write_folder(_rows(spark, 40), str(tmp_path), "log.json")
    assert [x["id"] for x in json.loads((tmp_path / "log.json").read_text())] == list(range(40))
    assert sorted(os.listdir(tmp_path)) == ["d", "log.json"] and {p.name: p.read_text() for p in (tmp_path / "d").iterdir()} == {f"f{i}": str(i) for i in range(40)}


def test_lost_tasks_leave_nothing(spark, tmp_path):
    """A task that fails half-way: the job is aborted, and neither files nor a document are there."""
    broken = _rows(spark, 40).withColumn("value", F.when(F.col("path") == "d/f33", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        write_folder(broken, str(tmp_path), "log.json")
    assert os.listdir(tmp_path) == []


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """Two attempts of one task, of which one is committed, as after a lost executor."""
    import pyarrow as pa
    import pyspark

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    writer = folder.FolderWriter({"path": str(tmp_path), "document": "log.json", "sections": "a,b"})
    batch_ = pa.RecordBatch.from_pydict({"path": ["x", None, None], "content": [b"1", None, None], "section": [None, "b", "a"], "value": [None, '{"k":1}', "2"]})
    real, messages = pyspark.TaskContext.get, []
    try:
        for attempt in (1, 2):
            pyspark.TaskContext.get = staticmethod(lambda attempt=attempt: Task(attempt))
            messages.append(writer.write(iter([batch_])))
    finally:
        pyspark.TaskContext.get = real
    assert sorted(os.listdir(tmp_path)) == [writer.job]
    writer.commit([messages[1], None])
    assert sorted(os.listdir(tmp_path)) == ["log.json", "x"] and json.loads((tmp_path / "log.json").read_text()) == {"a": [2], "b": [{"k": 1}]}


def test_no_file_is_lost(spark, tmp_path):
    given = [(0, "a.txt", b"0"), (1, "a.txt", b"1"), (2, "a (1).txt", b"2"), (3, "x/a.txt", b"3"), (4, "..", b"4"), (5, "b.txt", None)]
    office.save_files(spark.createDataFrame(given, "file_index long, file_name string, content binary"), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a.txt": b"0", "a (2).txt": b"1", "a (1).txt": b"2", "a (3).txt": b"3", "file": b"4"}


def test_files_in_memory(spark):
    doc = lambda *t, ext=".docx", media=None: samples.build(ext, [ooxml.Segment("body", "s", x) for x in t], media)
    uploads = [("a.docx", doc("From Acme Ltd", "mail a@b.co", media={"word/media/l.png": ooxml.blank("PNG", 2)})), ("b.xlsx", doc("Acme Ltd", ext=".xlsx")), ("c.txt", b"x"), ("d.docx", b"no zip"), ("e.docx", doc("nothing here"))]
    review, skipped = batch.run_scan(spark, uploads, [("Acme Ltd", "Client")])
    assert [(i["file_index"], i["text"], i["placeholder"]) for i in review["items"]] == [(0, "Acme Ltd", "Client A"), (0, "a@b.co", "janet.davis7753@example.com"), (1, "Acme Ltd", "Client A")]
    assert [n for n, _ in skipped] == ["c.txt", "d.docx"] and "can't be read" in skipped[1][1] and review["items"][2]["sheet"] == "body"
    images = batch.run_extract_images(spark, uploads)
    assert [(i["file_index"], i["id"], i["count"]) for i in images] == [(0, "word/media/l.png", 1)]
    review["images"] = [{"file_index": 0, "id": images[0]["id"]}]
    review["items"].append({"id": 9, "file_index": 3, "text": "x", "category": "Entity", "source": "list", "placeholder": "y"})
    files, log, outcomes = batch.run_apply(spark, review, uploads)
    assert [n for n, _ in files] == ["a.docx", "b.xlsx"] and [tuple(s)[2] for s in ooxml.segments(files[0][1], ".docx")] == ["From Client A", "mail janet.davis7753@example.com"]
    assert dict(ooxml.images(files[0][1], ".docx")) == {"word/media/l.png": ooxml.blank("PNG")} and log[0] == {"original": "Acme Ltd", "placeholder": "Client A"}
    assert [o["outcome"].split(":")[0] for o in outcomes] == ["masked", "masked", "nothing to mask", "failed", "nothing to mask"]


def test_constant_patterns(spark):
    """A list's patterns as constants are those that columns make, whatever signs are in them."""
    values = ["Bed Rock", "a\\Eb", "\\Q", "it's", "é\u3000x", "(x)", "$1 \\d", "a\x1cb", "[", "'"]
    made = spark.createDataFrame([(v,) for v in values], "v string").select("v", S.flexible(F.col("v")).alias("p")).collect()
    assert {r.v: r.p for r in made} == {v: S.flexible_text(v) for v in values}
    texts = spark.createDataFrame([(i, f"x {v}, y") for i, v in enumerate(values)] + [(99, None), (98, "")], "doc_id long, text string")
    listed = [(v, "c") for v in values]
    got = {r.doc_id: r["values"] for r in M.verify(texts, listed).collect()}
    assert all(values[i] in v for i, v in got.items() if i < 90) and got[98] == [] and 99 not in got


def test_slots(spark):
    names = ["a.jpg", "b.JPEG", "c.png", "d", "e.jpg.gif", "x/y.Jpg"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", office.slot_format(F.col("n")).alias("f")).collect()
    assert {r.n: r.f for r in got} == {n: ooxml.image_format(n) for n in names}


def test_many_candidates_in_a_text(spark):
    """100,000 overlapping candidates in one row, and small rows, beside a plain fold."""
    import bisect

    r = random.Random(1)
    made = lambda n, size, w: [(a := r.randint(0, size), a + r.randint(1, w)) for _ in range(n)]

    def plain(c):
        taken, out = [], []
        for a, b in c:
            i = bisect.bisect_left(taken, (a,))
            if (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a):
                taken.insert(i, (a, b))
                out.append((a, b))
        return out

    chain = [(i, i + 2) for i in range(3000)]
    r.shuffle(chain)
    all_ = [made(r.randint(0, 200), r.choice([30, 300, 3000]), r.choice([3, 30])) for _ in range(100)] + [made(100_000, 1_000_000, 30), chain, []]
    df = spark.createDataFrame(list(enumerate(all_)), "i int, s array<struct<start:int,end:int>>")
    for row in M.arbitrated(df, F.col("s"), "kept").collect():
        assert [tuple(x) for x in row.kept] == plain(all_[row.i])


@pytest.mark.parametrize("path", ["automaton", "join"])
@pytest.mark.parametrize("single", [True, False])
def test_places_of_long_lists(spark, monkeypatch, path, single):
    """Places told by words are those that the patterns find, letters included that fold in more ways than one."""
    r = random.Random(5)
    listed = [("kelvin", "a"), ("Class", "b"), ("is", "c"), ("class", "d"), ("x_1", "e"), ("ka", "f"), ("s", "g"), ("Strasse", "h")]
    listed += [] if single else [("is class", "i"), ("a-a", "j"), ("Straße", "k"), ("Σas", "l"), ("é", "m"), ("İs", "n"), ("class - is", "o")]
    parts = ["kelvin", "\u212aelvin", "KELVIN", "class", "Class", "is", "x_1", "x_1x", "Ka", "s", "a-a-a", "a-a", "straße", "STRAẞE", "σας", "ΣΑΣ", "É", "-", " ", " ", "\x1c", "\u3000", "\n", "ß"]
    parts += ["claſs", "İs", "ıs", "ſ"] if path == "automaton" else []
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)] + ["", None, "is class", "is class"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [rows(f(docs, listed)) for f in (lambda d, x: M.claims(d, x), M.verify)]
    monkeypatch.setattr(E, "LITERAL", 2)
    if path == "join":
        monkeypatch.setattr(E, "AUTOMATON", 0)
    assert [rows(f(docs, listed)) for f in (lambda d, x: M.claims(d, x), M.verify)] == want


def test_texts_of_many_listed_words(spark, monkeypatch):
    """No pattern is made for a word of a plain text, however many of the list it has."""
    monkeypatch.setattr(M.S, "flexible", lambda value: F.raise_error(F.lit("a pattern for each entity")).cast("string"))
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words) + " straße")], "doc_id long, text string")
    for limit in (1 << 20, 0):
        monkeypatch.setattr(E, "AUTOMATON", limit)
        assert M.claims(docs, [(w, "c") for w in words], use_regex=False).count() == M.verify(docs, [(w, "c") for w in words]).first().n_leaks == 3000


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_mappings_that_tasks_hold(spark, monkeypatch, limit):
    """As pair after pair: cascades, pairs that change nothing, shades, empty placeholders, keys without a mapping."""
    monkeypatch.setattr(M.mapped, "HELD", limit)
    r = random.Random(9)
    words = ["Acme", "Client", "A", "us", "café", "x-y", "New York", "York", "(b)", "b", "_1", "same", "-x-"]
    items = [(k, i, w, r.choice(["Client", "Address"]), "same" if w == "same" else r.choice(["Client A", "Address", "us", "", "<b>", "\\0 $1"])) for k in ("k", "l") for i, w in enumerate(r.sample(words, 10))]
    reviewed = spark.createDataFrame(items, "doc_id string, seq long, text string, category string, placeholder string")
    docs = spark.createDataFrame([(r.choice(["k", "l", "m", None]), "".join(r.choice([*words, " ", "-", " "]) for _ in range(r.randint(0, 14)))) for _ in range(300)] + [("k", None), ("l", "")], "doc_id string, text string")
    want = M.apply(docs, reviewed)
    assert rows(M.apply(docs, reviewed, many=True)) == rows(want) and want.where("changed").count() > 50


def test_a_text_of_many_mapped_words(spark, monkeypatch):
    """A mapping that tasks hold makes no pattern for a word."""
    monkeypatch.setattr(M, "replace_word", lambda t, o, p: F.raise_error(F.lit("a pattern for each pair")).cast("string"))
    words = [f"w{i}" for i in range(2000)]
    reviewed = spark.createDataFrame([(1, i, w, "Client", f"<{w.upper()}>") for i, w in enumerate(words)], "doc_id long, seq long, text string, category string, placeholder string")
    got = M.apply(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), reviewed, many=True).first()
    assert got.masked == " ".join(f"<{w.upper()}>" for w in words) and got.changed
