"""Each operator beside a plain version of its contract, on small made-up texts and the smallest tables."""

import array
import hashlib
import random
import re
import zlib
from collections import Counter as Count

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from umbra.llm import blocks, line_dedup, packing, quality, queries, simhash, substring_dedup, suffix_dedup, token_counts
from umbra.llm.chat import format_conversations, loss_text, read_back
from umbra.llm.fingerprints import fingerprints

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, block int"
WORD = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORD, t or "")


@pytest.fixture(scope="module")
def made():
    """Copies, shared passages, repeats inside a text, nulls, empty and one-word texts, a long text."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    shared = [say(60) for _ in range(4)]
    texts = [None, "", " \n\t", "one", "one two"] + [say(r.randint(3, 120)) for _ in range(20)]
    texts += [f"{say(15)} {r.choice(shared)} {say(15)}" for _ in range(20)] + [shared[0] + "\n" + shared[0], say(4000)]
    texts += r.sample(texts, 12)
    return [(i * 3, t, r.choice(["en", "fr", None]), r.choice(["a", "b", None]), len(t or ""), "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, made):
    return spark.createDataFrame(made, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_substring(docs, made):
    seen, want = set(), {}
    for d, t, *_ in made:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    assert by_id(substring_dedup.substring_dedup(docs), "n_words", "n_removed", "kept_sha256") == want
    assert sum(v[1] for v in want.values()) > 1000


@pytest.mark.parametrize(("step", "hot"), [(suffix_dedup.STEP, suffix_dedup.HOT), (300, 1), (300, 4)])
def test_suffix(docs, made, monkeypatch, step, hot):
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    seen, want = set(), {}
    for d, t, *_ in made:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if k in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(k)
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert by_id(suffix_dedup.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_cuts_of_huge_texts(made, monkeypatch):
    monkeypatch.setattr(blocks, "HUGE", 2000)
    text = max((m[1] or "" for m in made), key=len)
    parts, n = substring_dedup._cut(text.encode()), len(text.split())
    assert len(parts) > 3 and [base + i for base, p in parts for i in range(len(p.split()) - 19)] == list(range(n - 19))
    cut = suffix_dedup._cut(text.encode())
    assert [base + i for base, p in cut for i in range(len(p) - 99)] == list(range(len(text.encode()) - 99))


def test_huge_texts(spark):
    """Texts beyond HUGE go through both removers in parts: passages that repeat inside one, across its cuts, and in others."""
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    passage, long = say(120), say(700_000)
    assert len(long) > blocks.HUGE
    words_ = long.split()
    middle = words_[260_000:260_200]
    rows = [(1, long), (2, f"{say(30)} {passage}"), (3, f"{say(300_000)} {passage} {say(320_000)} {' '.join(middle)} {say(5)} {passage}"), (4, long), (5, " ".join(words_[len(words_) // 2 - 2000 : len(words_) // 2 + 2000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sub = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.substring_dedup(df, keep_texts=False).collect()}
    assert sub == {1: (700_000, 0), 2: (150, 0), 3: (620_445, 440), 4: (700_000, 700_000), 5: (4000, 4000)}
    suf = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(df).drop("kept").collect()}
    assert suf[1] == suf[2] == (0, 0) and suf[4] == (len(long), 1) and suf[5] == (len(rows[4][1]), 1)
    # A passage and what happens to be alike beside it.
    assert suf[3][1] == 3 and 0 <= suf[3][0] - (2 * len(passage) + len(" ".join(middle))) <= 30


def test_multikey_sort():
    r = random.Random(1)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(400)) * 2, np.uint8)
    starts = np.arange(len(data) - 99)
    seen, want = set(), []
    for s in starts:
        k = data[s : s + 100].tobytes()
        want.append(k in seen)
        seen.add(k)
    assert suffix_dedup.multikey(data, starts).tolist() == want


def linked(fp):
    ids, root = sorted(fp), {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fp[a] ^ fp[b]).count("1") <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: ("%016x" % fp[d], find(d)) for d in ids}


def plain_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, made):
    want = linked({d: plain_fingerprint(t) for d, t, *_ in made})
    assert by_id(simhash.simhash_groups(docs), "fingerprint", "component_id") == want


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_near_each_other(spark, monkeypatch, hot):
    """Chains of fingerprints three bits apart, also where posting lists are split."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r, fps = random.Random(5), set()
    for _ in range(15):
        x = r.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
    fp = dict(enumerate(sorted(fps)))
    signed = {d: v - (1 << 64) if v >> 63 else v for d, v in fp.items()}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    top = {r.u: r.v for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for d, v in signed.items():
        groups.setdefault(top.get(v, v), []).append(d)
    want = {}
    for d, (_, c) in linked(fp).items():
        want.setdefault(c, []).append(d)
    assert sorted(groups.values()) == sorted(want.values())


def test_line_dedup(docs, made, monkeypatch):
    lines, want = [], {}
    for d, t, *_ in made:
        own = list(dict.fromkeys(x for x in (t or "").split("\n") if words(x)))
        kept = []
        for i, x in enumerate(own):
            w = set(words(x))
            if not any(5 * len(w & v) >= 4 * len(w | v) for v in lines):
                kept.append(i)
            lines.append(w)
        want[d] = (len(own), kept)
    for hot in (256, 1):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert by_id(line_dedup.kept_lines(docs), "n_lines", "kept") == want
    texts = by_id(line_dedup.line_dedup(docs), "text", "n_kept")
    for d, t, *_ in made:
        own = list(dict.fromkeys(x for x in (t or "").split("\n") if words(x)))
        assert texts[d] == ("\n".join(own[i] for i in want[d][1]), len(want[d][1]))


def test_line_dedup_long_lines(spark, monkeypatch):
    """Long lines that share rare words and no more are no candidates; those about as long as a bitmap has bits are found as others are."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    lines = [r.sample(vocab, r.randint(90, 120)) for _ in range(60)]
    for n in (55, 63, 64, 65, 70, 140):
        base = [f"u{n}-{i}" for i in range(n)]
        lines += [[w if r.random() < p else f"x{n}-{p}-{i}" for i, w in enumerate(base[: n - cut])] for p in (1, 0.95, 0.88) for cut in (0, 3, 9)]
    sets = [set(x) for x in lines]
    want = {i: () if any(5 * len(w & v) >= 4 * len(w | v) for v in sets[:i]) else (0,) for i, w in enumerate(sets)}
    df = spark.createDataFrame([(i, r.choice("\t ").join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    keep, sizes = line_dedup.stored, []

    def counting(made, name):
        made = keep(made, name)
        if name == "candidates":
            sizes.append(made.where("key is null and x < y").count())
        return made

    monkeypatch.setattr(line_dedup, "stored", counting)
    for hot in (256, 1):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert {x.doc_id: tuple(x.kept) for x in line_dedup.kept_lines(df).collect()} == want
    assert any(want.values()) and not all(want.values())
    near = sum(5 * len(w & v) >= 4 * len(w | v) for i, w in enumerate(sets) for v in sets[:i])
    assert sizes[0] <= near + 120  # of 1,770 pairs of the first 60 lines hardly any


def test_quality(docs, made):
    got = by_id(quality.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t, *_ in made:
        t = t or ""
        w = words(t)
        n, mark = Count(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [0] * len(w)
        for i in range(len(w) - 4):
            if n[tuple(w[i : i + 5])] > 1:
                mark[i : i + 5] = [1] * 5
        ls = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * sum(mark) > 20 * len(w)
        assert got[d][:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), sum(mark), failed)
        assert not (failed and got[d][6])


def test_quality_common_words_of_any_script(spark):
    """Words of scripts without case, long and capitalised ones and ones with marks are in the reference, and a document without them is rejected."""
    r = random.Random(2)
    alphabets = {"ar": "ابتثجحخدذرزسشصض", "hi": "कखगघचछजझटठडढिीा", "ko": "가나다라마바사아자차카", "de": "ABCDÄbcdeßü"}
    rows = []
    for lang, letters in alphabets.items():
        common = sorted({"".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(16)})
        rare = lambda x=letters: "".join(r.choice(x) for _ in range(12))
        rows += [(lang, " ".join(r.choice(common) if r.random() < 0.6 else rare() for _ in range(150))) for _ in range(30)]
        rows.append((lang, " ".join(rare() for _ in range(150))))
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    tops = {x.lang: [(y.word, y.n) for y in x.top] for x in quality.common_words(df).collect()}
    for lang in alphabets:
        n = Count(w for k, t in rows if k == lang for w in words(t) if re.fullmatch(r"[^\W\d_]+", re.sub("[िीा]", "", w) or "x"))
        assert tops[lang] == sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]
    judged = by_id(quality.judge(df), "word_distance", "kept")
    bad = [i for i, (lang, _) in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][0] != lang]
    assert all(judged[i][1] is (i not in bad) for i in judged) and all(judged[i][0] > quality.WORD_DISTANCE for i in bad)


def test_quality_separates_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = ([r.kept for r in judged.where(f"quality = {q}").select("kept").collect()] for q in (1, 0))
    assert all(good) and sum(bad) < 0.35 * len(bad)


def tiles(pieces):
    end = 0
    for at, n in sorted(pieces):
        assert at == end and n > 0
        end += n
    return end


def test_packing(docs, made):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x, *_ in made}
    rows, seqs, got = packing.pack(docs, P.path("word_bpe_49k.json")).collect(), {}, {}
    for r in rows:
        a = ids[r.doc_id]
        assert r.doc_tokens == len(a) and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: tiles(x) for d, x in got.items()} == {d: len(a) for d, a in ids.items()}
    sizes = [tiles(seqs[i]) for i in range(len(seqs))]
    assert all(n == 2048 for n in sizes[: sum(sizes) // 2048]) and all(n & (n - 1) == 0 for n in sizes)
    total, share = sum(map(len, ids.values())), Count()
    for r in rows:
        share[r.source] += r.length
    for i in range(sum(sizes) // 2048):
        own = Count()
        for r in rows:
            own[r.source] += r.length * (r.sequence_id == i)
        assert all(abs(own[s] - 2048 * n / total) <= 2 * packing.QUANTUM for s, n in share.items())


def test_packing_of_many_sources(spark):
    """400 sources, each in one run of the input: each keeps its share of any beginning of the stream to within two quanta, and the tiny ones are spread."""
    r = random.Random(4)
    sizes = [3000, 1500] + [300] * 298 + [20] * 100
    rows = [(1000 * s + i, " ".join(f"w{r.randint(0, 99)}" for _ in range(n // parts)), f"site{s:03}") for s, n in enumerate(sizes) for parts in [4 if n > 100 else 1] for i in range(parts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4, "source")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for d, x, _ in rows}
    got, seqs, docs = packing.pack(df, P.path("word_bpe_49k.json")).collect(), {}, {}
    for x in got:
        assert x.doc_tokens == len(ids[x.doc_id]) and zlib.crc32(ids[x.doc_id][x.start : x.start + x.length].tobytes()) == x.ids_crc32
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
        docs.setdefault(x.doc_id, []).append((x.start, x.length))
    assert {d: tiles(x) for d, x in docs.items()} == {d: len(a) for d, a in ids.items()}
    ends = np.cumsum([tiles(seqs[i]) for i in range(len(seqs))])
    total, count = int(ends[-1]), {}
    assert total == sum(map(len, ids.values())) and all(n % 2048 == 0 for n in ends[: total // 2048])
    stream = np.empty(total, int)
    for x in got:
        at = (ends[x.sequence_id - 1] if x.sequence_id else 0) + x.offset
        stream[at : at + x.length] = int(x.source[4:])
    at = np.arange(1, total + 1)
    for s in range(len(sizes)):
        count[s] = np.cumsum(stream == s)
        assert np.abs(count[s] - count[s][-1] * at / total).max() <= 2 * packing.QUANTUM
    tiny = np.cumsum(stream >= 300)
    assert np.abs(tiny - tiny[-1] * at / total).max() < 0.1 * tiny[-1]


def odd():
    r = random.Random(1)
    return [
        "", " ", "x" * 3000 + " y", " " * 3000, "ab \u0085 \x1c\x1d c'll  d 's\r\n" * 100, "a<|endoftext|>b " * 200, "漢字 かな " * 300,
        *("".join(r.choice(c) for _ in range(4000)) for c in ("ab 1.\n'sé漢 \t", "ab 1.\n'sé \t\x1c", "a \n")),
    ]


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", r"<\s> [\\INST] <<SYS>> <<\SYS>>", "", None, "a\\", "<", "[", "/s>", "<<s>", "$1 \\E"]
    roles = ["system", "user", "assistant", "tool</s>", None]
    rows = [(i % 7, i // 7, roles[i % 5], said[i % 10]) for i in range(70)] + [(9, 0, "user", "q"), (9, 1, "assistant", "r"), (9, 1, "assistant", "r")]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in made.select("conv_id", "valid", read_back(F.col("formatted")).alias("t"), loss_text(F.col("segments")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(x.role, x.text) for x in got[c].t] == [(r, x) for _, r, x in own]
        assert got[c].loss == "".join(x for _, r, x in own if r == "assistant")
    assert not got[9].valid and not got[0].valid
    fine = [(1, i, r, "x") for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    assert format_conversations(spark.createDataFrame(fine, "conv_id long, turn long, role string, text string")).first().valid


def test_empty_tables(none, spark):
    for f in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, simhash.simhash_groups, line_dedup.line_dedup, quality.judge, fingerprints):
        assert f(none).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "other " + text)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    sub = sorted((r.doc_id is not None, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert sub == [(False, 0), (True, 40), (True, 40), (True, 40)]
    assert suffix_dedup.suffix_dedup(df).count() == simhash.simhash_groups(df).count() == quality.judge(df).count() == 4
    assert [r.component_id for r in simhash.simhash_groups(df).where("doc_id is null").collect()] == [None]
    assert {r.doc_id for r in line_dedup.line_dedup(df).collect()} == {None, 5}


def test_pipeline(spark):
    """Stages one after the other, each against what its operator says of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == columns and 0 < len(rows) <= docs.count(), name
        assert all(r.n_chars == len(r.text) for r in rows)
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert {r.doc_id for r in rows} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in rows} == {d for d, (_, c) in linked({d: plain_fingerprint(t) for d, t in before.items()}).items() if c == d}
        docs = spark.createDataFrame(rows, out.schema)
    assert stage and corpus_pipeline.packing(spark, docs, SF).agg(F.sum("length")).first()[0] > 0


def test_pipeline_keeps_each_row(spark, tmp_path):
    """run() beside its five stages in plain Python, with repeated rows, namesakes of other texts, null doc_ids. Texts are too short for the two distances."""
    r = random.Random(7)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, e = (say(24) for _ in range(5))
    part = say(21)
    rows = [(5, a), (5, a), (6, b), (6, "too short"), (7, say(12) + "\n" + say(12)), (7, c), (None, d), (None, d), (None, e), (8, f"{say(5)} {part}"), (9, f"{part} {say(6)}"), (10, None), (11, a), (12, f"{say(11)}\n{c}")]
    rows = [(i, t, "en", "web", len(t or ""), f"mine {n}", 1, None, "x", n) for n, (i, t) in enumerate(rows)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, new_text string, own int, _row long, _New string, `a.b` int"
    docs = spark.createDataFrame(rows, extra).repartition(3)
    docs.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        own = {x["a.b"]: (x.doc_id, x.new_text) for x in kept.collect()}
        assert own and all(own[n] == (rows[n][0], rows[n][5]) for n in own), name
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    order = lambda ds: sorted(ds, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    now = order((i, t) for i, t, *_ in rows if len(words(t)) >= 10)
    seen, left = [], []
    for i, t in now:
        kept = []
        for x in dict.fromkeys(x for x in t.split("\n") if words(x)):
            w = set(words(x))
            if not any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                kept.append(x)
            seen.append(w)
        if kept:
            left.append((i, "\n".join(kept)))
    groups = linked({n: plain_fingerprint(t) for n, (_, t) in enumerate(left)})
    left = [x for n, x in enumerate(left) if groups[n][1] == n]
    known, want = set(), []
    for i, t in left:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in known:
                gone[s : s + 20] = [True] * 20
            known.add(k)
        t = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t
        if t:
            want.append((i, np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")))
    assert Count(i for i, _ in want) == {None: 2, 5: 1, 6: 1, 7: 2, 8: 1, 9: 1, 12: 1}
    got, free = corpus_pipeline.run(spark, str(tmp_path)).collect(), Count((i, ids.tobytes()) for i, ids in want)
    pieces = {}
    for x in got:
        fits = [k for k in free if k[0] == x.doc_id and len(k[1]) == 4 * x.doc_tokens and zlib.crc32(k[1][4 * x.start : 4 * (x.start + x.length)]) == x.ids_crc32]
        assert len(fits) == 1
        pieces.setdefault(fits[0], []).append((x.start, x.length))
    assert {k: tiles(x) for k, x in pieces.items()} == {k: len(k[1]) // 4 for k in free} and set(free.values()) == {1}
