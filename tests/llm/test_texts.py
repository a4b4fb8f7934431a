"""Operators on single texts: edge cases and brute force."""

import re
import zlib
from array import array
from collections import Counter
from hashlib import sha256

import pytest

pytest.importorskip("brightloom.llm.queries")
P = pytest.importorskip("public_tokenizers")

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, kept string, n_words int, spans string, length int, rid int"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "a", LONG, "x " * 200, "ä ß 日本語 😀\n\n" * 30, "The cat and the dog sat on the mat of the house. " * 12, "The cat and the dog sat on the mat of the house. " * 12]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    rows = [(None if i == 3 else i // 2, t, "k", i, None, 7, None) for i, t in enumerate(TEXTS)] + [(None,) * 7]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_measures(odd, none):
    from brightloom.llm.quality import quality

    got = quality(odd.select("doc_id", "text", "n_words", "kept")).collect()
    assert len(got) == len(TEXTS) + 1
    by = {}
    for r in got:
        w = words(r["text"])
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {i + d for i, g in enumerate(seen) if seen.count(g) > 1 for d in range(3)} if len(w) < 1000 else None
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        if cover is not None:
            assert r["n_repeat_words"] == len(cover)
        if len(w) < 50:
            assert r["base_failed"] and not r["kept"]
        by[r["text"]] = r
    assert by["x " * 200]["base_failed"]
    assert quality(none).count() == 0
    # The words of the long text would be split again for each of them if this filter went below the measures.
    assert quality(odd.select("doc_id", "text")).where("kept").count() == sum(r["kept"] for r in got)


def test_packing(odd, none, spark):
    from tokenizers import Tokenizer

    from brightloom.llm.packing import pack, pack_documents, sequences

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    marks = [(50, "a <|endoftext|> b"), (51, "x<|startoftext|>Y it's 12 O'Neill's")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(marks, "doc_id bigint, text string"))
    ids = lambda t: tuple(lib.encode(t or "", add_special_tokens=False).ids) + (0,)
    assert 49407 in ids(marks[0][1])
    want = Counter()
    for doc_id, text in docs.collect():
        whole = ids(text)
        for k in range(0, len(whole), 2048):
            part = whole[k : k + 2048]
            want[doc_id, k // 2048, k, len(part), zlib.crc32(array("I", part).tobytes()), part] += 1
    packed = pack_documents(docs, path, 2048, with_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in packed) == want
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    plain = pack_documents(docs, path, 2048).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in plain) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
    seqs = sequences(pack_documents(docs, path, 2048, with_ids=True)).collect()
    assert sorted(len(s["ids"]) for s in seqs) == sorted(sum(n for _, n in p) for p in places.values())
    assert all(s["offsets"] == sorted(s["offsets"]) and s["offsets"][0] == 0 for s in seqs)
    assert pack_documents(none, path).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(9,)], "length int"), 8)


def test_packing_plan_is_best_fit_decreasing():
    import random

    from brightloom.llm.packing import plan

    for seed in range(200):
        rng = random.Random(seed)
        capacity = rng.choice([5, 16, 33, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        bins = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = [i for i, left in enumerate(bins) if left >= n]
                if fit:
                    bins[min(fit, key=lambda i: bins[i])] -= n
                else:
                    bins.append(capacity - n)
        rows, total = plan(counts, capacity)
        assert total == len(bins)
        held = {}
        for n, a, b, each, first, offset in rows:
            for k in range(b - a):
                held.setdefault(first + k // each, []).append((offset + k % each * n, n))
        left = []
        for parts in held.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            left.append(capacity - at)
        assert sorted(left) == sorted(bins)


def test_word_ids_equal_the_library(documents):
    from tokenizers import Tokenizer

    from brightloom.llm import tokens

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    unmade = tokens.merge_ranks(path)
    assert unmade is not None
    letters = [chr(c) for c in range(0x20, 0x2C0)] + [chr(c) for c in range(0x1E00, 0x1F00)]
    texts = [t for c in letters for t in (c, f"a{c}b", f"A{c} {c}b{c}")] + ["".join(letters), " ".join(letters), *(t or "" for t in TEXTS)]
    texts += [r["text"] or "" for r in documents.collect()]
    texts += ["a <|endoftext|> b", "<|endoftext|", "x<|startoftext|>y", "\x1c a\x1db", "e\u0301 \u0301e", "don't I'LL 'tis 've'", "漢字 かな 😀😀 ١٢٣"]
    want = [array("I", e.ids).tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    vocab = tokens.WordIds(path, unmade)
    assert list(vocab.texts(texts)) == want
    assert list(vocab.texts(texts)) == want  # now from the kept words
    vocab.held = tokens.KEPT_BYTES + 1  # and from the older generation
    assert list(vocab.texts(texts)) == want and vocab.old
    assert list(tokens.WordIds(path, None).texts(texts)) == want  # where merging by ids is not allowed


def test_merging_by_ids_is_checked():
    from brightloom.llm.tokens import _merged

    # "abc" is listed as ab + c, but alone bc comes first: no merging ends in it.
    order = {("b", "c"): 0, ("a", "b"): 1, ("ab", "c"): 2}
    assert _merged(["a", "b", "c"], order) == ["a", "bc"]


def test_pieces_equal_the_library(odd, documents, none):
    import sentencepiece

    from brightloom.llm.pieces import digest_documents, encode_documents, load

    path = P.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), load(path)
    hard = ["", " ", "  a", "a  ", " \n\t x", "▁▁ a▁b", "日本語 テスト😀😀", "a" * 3000, "  " * 100, "\x00a\x01", "<s> </s> <0x41>"]
    for t in hard + [r["text"] for r in documents.limit(60).collect()]:
        proto = lib.encode(t, return_type="proto")
        assert own.encode(t) == [(p.id, p.begin, p.end) for p in proto.pieces]
        assert own.decode([p.id for p in proto.pieces]) == lib.decode([p.id for p in proto.pieces])
    for r in digest_documents(odd.where("doc_id is not null"), path).collect():
        assert r["n_tokens"] >= 0
    digests = {r["doc_id"]: r for r in digest_documents(documents, path).collect()}
    for r in encode_documents(documents.limit(20), path).collect():
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(r["ids"])
        assert d["ids_sha256"] == sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert d["decoded_sha256"] == sha256(lib.decode(r["ids"]).encode()).hexdigest()
    assert digest_documents(none, path).count() == 0 and digest_documents(odd, path).count() == len(TEXTS) + 1


def test_character_map_is_followed():
    """A trie with two keys, built by hand, and its longest match."""
    import struct

    from brightloom.llm.pieces import CharMap

    keys = {b"ab": b"X", b"abc": b"YZ"}
    strings, at = b"", {}
    for k, v in keys.items():
        at[k] = len(strings)
        strings += v + b"\0"
    units, next_free = [0] * 2048, [256]

    def place(node, prefix):
        """Children of ``node`` go to a block of their own."""
        children = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        base = next_free[0]
        next_free[0] += 256
        units[node] |= (node ^ base) << 10
        if prefix in keys:
            units[node] |= 1 << 8
            units[base] = at[prefix] | 0x80000000
        for c in children:
            units[base ^ c] |= c
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings
    m = CharMap(blob)
    assert m.longest(b"abcd", 0) == (b"YZ", 3) and m.longest(b"xabd", 1) == (b"X", 2) and m.longest(b"a", 0) is None and m.longest(b"b", 0) is None


def test_media_round_trip(odd, none):
    import os

    from brightloom.llm import media

    for n in (0, 1, 576, 937, 938, 20_000):
        for raw in (os.urandom(n), b"\xff" * n, (b"\xff\xfb\x90\xc0" * (n // 4 + 1))[:n]):
            stored = media.build(raw)
            s = media.parse(stored)
            assert media.payload(stored, s) == raw and s.resyncs == 0 and s.table["tag_ok"] and s.samples == 1152 * len(s.offsets)
    stored = media.build(os.urandom(20_000))
    _, tag = media.id3v2(stored)
    s = media.parse(stored[:tag] + b"\0\xff\xfbnoise\xff\xfa" + stored[tag:])
    assert s.resyncs == 1 and s.music_ok and len(s.offsets) == s.table["frames"]
    hurt = bytearray(stored)
    hurt[media.parse(stored).offsets[3] + 1] = 0
    s = media.parse(bytes(hurt))
    assert s.resyncs == 1 and len(s.offsets) == s.table["frames"] - 1 and not s.music_ok
    with pytest.raises(ValueError):
        media.payload(bytes(hurt), s)
    assert media.parse(None).duration_us == 0 and media.parse(b"\xff" * 1000).offsets == []
    got = media.stored_payloads(odd).collect()
    assert len(got) == len(TEXTS) + 1
    assert sorted(r["payload_sha256"] for r in got) == sorted(
        sha256(b + b"\xff" * (-len(b) % 576 or 576 * (not b))).hexdigest() for b in ((t or "").encode() for t in [*TEXTS, None])
    )
    assert all(r["duration_us"] == 24_000 * len(r["seek_offsets"]) and r["seek_offsets"] == sorted(r["seek_offsets"]) for r in got)
    assert media.stored_payloads(none).count() == 0


def test_media_parser_reads_anything():
    """Cut, damaged and hostile files: each has a row of the declared types, with an error at worst."""
    import os
    import random
    import struct

    import pyarrow as pa

    from brightloom.llm import media
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T._parse_datatype_string(media.COLUMNS))
    rng = random.Random(4)
    whole = media.build(os.urandom(3_000))
    frame = whole[media.id3v2(whole)[1] :]
    vbri = bytearray(frame[:200])
    vbri[36:62] = b"VBRI" + bytes(6) + struct.pack(">II4H", 1, 2, 65535, 65535, 4, 9)
    files = [
        b"ID3\x04\0\x40\0\0\0\x02\x01", b"ID3\x04\0\x40\0\0\0\0", b"ID3\x03\0\x40\0\0\0\x03\0\0", bytes(vbri), bytes(vbri) + frame, frame[:36] + b"VBRI" + frame[40:58],
        b"ID3\x02\0\0\0\0\0\x0bTT2\0\0\x05\0abcd" + frame, b"\xff", b"\xff\xfb", b"TAG", b"TAG" + bytes(125),
    ]
    for _ in range(600):
        hurt = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.5 else whole)
        for _ in range(rng.randrange(20)):
            if hurt:
                hurt[rng.randrange(len(hurt))] = rng.choice((0, 255, rng.randrange(256)))
        files.append(bytes(hurt))
    rows = [media._parsed(f) for f in files]
    assert len(pa.array([dict(zip([f.name for f in kind], r, strict=True)) for r in rows], kind)) == len(files)
    assert all(r[-1] is None for r in rows) and rows[6][6] == {"TT2": "abcd"}
    assert media._parsed(7)[-1].startswith("TypeError")  # what can't be read at all


def test_media_columns(spark):
    from brightloom.llm import media

    df = spark.createDataFrame([(1, bytearray(media.build(b"hello"))), (2, None), (3, bytearray(b"junk"))], "id int, content binary")
    got = {r["id"]: r["media"] for r in media.media_columns(df.withColumnRenamed("content", "content")).collect()}
    assert got[1]["mpeg"] == "1.3" and got[1]["vbr"] == "Xing" and got[1]["seek_offsets"] and got[1]["tags"]["TXXX:payload"] == "5" and got[1]["duration_us"] == 24000
    assert got[2]["n_frames"] == 0 and got[3]["mpeg"] is None


def test_html(spark, none):
    from brightloom.llm import htmlmain as h

    model = h.weights()
    good = total = 0
    for page, labels in h._training_pages(120, 99):
        found = h.blocks(page)
        assert len(found) == len(labels)
        good += h.content(page, model) == [b.text for b, y in zip(found, labels, strict=True) if y]
        total += 1
    assert good >= 0.95 * total
    page = (
        "<body><header><nav><a href=x>Home</a></nav></header><div class='cookie-banner'>We use cookies to improve your experience on this site</div>"
        "<article><h2>Title</h2><p>Hello &amp; good&nbsp;day <a href='#'>link</a> the text\n goes on.<p>Two<script>var x = '<p>no</p>'</script></article>"
        "<section id=comments><p>Great post, the best of all the posts I read this year!</p></section><footer>&copy; me</footer>"
    )
    assert h.main_text(page) == "Title\nHello & good day link the text goes on.\nTwo"
    for broken in (None, "", "<", "<p", "<p class='x", "<!-- ", "text only &am", "<script>x", "</p></div>", "<p>" * 3000):
        assert isinstance(h.main_text(broken), str)
    df = spark.createDataFrame([(1, "u", page, "old"), (1, "u", page, "old"), (None, None, None, None)], "page_id int, url string, html string, text string")
    got = h.extract(df).collect()
    assert len(got) == 3 and got[0]["text"] == got[1]["text"] and sorted(r["text"] for r in got)[0] == ""
    assert h.extract(df.limit(0)).count() == 0


#: Pages unlike those that the classifier is fitted to, with their main text as read by hand.
PAGES = [
    ("<p title=it's>Hello world</p><p>I don't know</p><p>last one here</p>", "Hello world\nI don't know\nlast one here"),
    ('<p data-x="5" 6">Kept?</p><p>say "hi" now</p>', 'Kept?\nsay "hi" now'),
    ("<html><head><title>No</title><meta charset=utf-8><p>The head was never closed, and the text of the page goes on.", "The head was never closed, and the text of the page goes on."),
    ("<!-->one of the first words here <!--->and the second<!-- <p>no --!> and the third of them", "one of the first words here and the second and the third of them"),
    (
        "<table id=layout><tr><td class=menu><a href=1>Start</a><br><a href=2>News</a><td><div><b>The old page in a table</b>"
        "<p>It was written by hand a long time ago, and it is in the middle cell of the table.<p>The second paragraph of the text is here, and it is the last.</div></table>",
        "The old page in a table\nIt was written by hand a long time ago, and it is in the middle cell of the table.\nThe second paragraph of the text is here, and it is the last.",
    ),
    (
        "<body><ul class='topmenu nav'><li><a href=/>Home</a><li><a href=/a>About</a></ul><div id=story><h1>A story of the sea</h1><p>The ship left the harbour in the morning of the first of May.</p>"
        "<div class=advert><a href=x>Buy the best boots of the year</a></div><p>It came back in the evening, and the crew was <b>not</b> the same as before.</p>"
        "<blockquote title='hidden treasure'>I saw it, said the keeper of the light.</blockquote></div><div class=comments><p>I do not believe a word of it, and you should not either.</p></div>"
        "<div class=footer>&copy; 2001 The Harbour Times</div>",
        "A story of the sea\nThe ship left the harbour in the morning of the first of May.\nIt came back in the evening, and the crew was not the same as before.\nI saw it, said the keeper of the light.",
    ),
    (
        "<main><h2>Steps</h2><ol><li>Take the bread out of the oven and let it rest for a while.<li>Cut it in the middle.<li>Eat.</ol></main><form action=/s>Search the site <input name=q></form>",
        "Steps\nTake the bread out of the oven and let it rest for a while.\nCut it in the middle.\nEat.",
    ),
    ("<article><p>Caf&eacute; &lt;tag&gt; &#x41;&#66; &notanentity; AT&T<sub>2</sub> the end</p><svg><text>drawn<p>after the drawing, the text goes on as it was</article>", "Café <tag> AB ¬anentity; AT&T2 the end\nafter the drawing, the text goes on as it was"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_html_pages_read_by_hand(page, text):
    from brightloom.llm.htmlmain import main_text

    assert main_text(page) == text


def test_html_long_and_deep_pages():
    import time
    import tracemalloc

    from brightloom.llm.htmlmain import main_text

    prose = "the words of the page " * 40_000
    assert main_text(f"<article><p>{prose}</p></article>") == prose.strip()
    for page, text in (("<div>" * 100_000 + "<p>the deep text of the page", "the deep text of the page"), ("<b><p>the text of it</b>" * 5_000, "\n".join(["the text of it"] * 5_000))):
        tracemalloc.start()
        began = time.time()
        assert main_text(page) == text
        assert tracemalloc.get_traced_memory()[1] < 200e6 and time.time() - began < 60
        tracemalloc.stop()


def test_html_minimum_cut_is_minimal():
    from itertools import product
    from random import Random

    from brightloom.llm.htmlmain import Flow

    rng = Random(5)
    for _ in range(60):
        n = rng.randint(1, 6)
        a, b = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        s = [rng.random() for _ in range(n - 1)]
        cost = lambda side: sum(b[i] if side[i] else a[i] for i in range(n)) + sum(w for i, w in enumerate(s) if side[i] != side[i + 1])  # noqa: E731, B023
        flow = Flow(n + 2)
        for i in range(n):
            flow.edge(n, i, a[i])
            flow.edge(i, n + 1, b[i])
        for i, w in enumerate(s):
            flow.edge(i, i + 1, w, w)
        assert abs(cost(flow.source_side(n, n + 1)[:n]) - min(map(cost, product([False, True], repeat=n)))) < 1e-6


def test_secret_queries_and_spans(spark, odd, none):
    from brightloom.llm.secrets import RULES, redact, scan, spans_text, trigram_query
    from pyspark.sql import functions as F

    by = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert by["hex"] is True and by["access"] == ("and", ("aki", "kia")) and by["assign"][0] == "or" and len(by["assign"][1]) == 6
    texts = [
        "x PassWord = 'abc123!' y", "secret: token: abcdef1", "api_key=short apikey:longer_one", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "é" * 5 + "0" * 24 + "g" + "f" * 23,
        "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"###", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20, None, "",
    ]
    kinds = [r.kind for r in RULES]

    def brute(t):
        out = []
        for k, r in enumerate(RULES):
            p = "[0-9a-f]+" if r.kind == "hex" else r.pattern
            out += [(m.start(), k, m.end()) for m in re.finditer(p, t or "", re.ASCII) if len(m.group(r.group)) >= r.least]
        return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out))

    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, spans string")
    got = {r["doc_id"]: r["s"] for r in scan(df).select("doc_id", spans_text(F.col("spans")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    clean = {r["doc_id"]: r for r in redact(df).collect()}
    assert clean[5]["text"] == '[secret]"###' and clean[7]["text"] is None and clean[1]["spans"] == "old"
    assert redact(df).columns == df.columns and redact(odd).count() == len(TEXTS) + 1 and redact(none).count() == 0


def test_licenses(spark, odd, none):
    from brightloom.llm.licenses import TEMPLATES, scan, template_shingles

    filler = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "MIT", f"{filler} released under the MIT license. {filler}", f"{filler} {TEMPLATES['MIT-text']} {filler}", " ".join(TEMPLATES["GPL-header"].split()[:-2]), " ".join(TEMPLATES["GPL-header"].split()[:20])]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], None)], "doc_id int, text string, license string")
    got = sorted((r["doc_id"], r["license"]) for r in scan(df).collect())
    # The GNU notices share most of their words, so the other versions hold 80 percent of themselves in the text too.
    gnu = [(5, n) for n in ("AGPL-3.0-header", "GPL-2.0-header", "GPL-header", "LGPL-3.0-header")]
    assert got == [(3, "MIT"), (3, "MIT"), (4, "MIT-text"), *gnu]
    shares = {r["license"]: r["n_matched"] / r["n_template"] for r in scan(df.where("doc_id = 5")).collect()}
    assert max(shares, key=shares.get) == "GPL-header"
    whole = spark.createDataFrame([(i, f"{filler} {t} {filler}") for i, t in enumerate(TEMPLATES.values())], "doc_id int, text string")
    found = {(r["doc_id"], r["license"]): (r["n_matched"], r["n_template"]) for r in scan(whole).collect()}
    assert all(found[i, name][0] == found[i, name][1] for i, name in enumerate(TEMPLATES))
    grams = {name: set(s) for name, s in template_shingles(TEMPLATES).items()}
    texts = template_shingles({str(i): f"{filler} {t} {filler}" for i, t in enumerate(TEMPLATES.values())})
    assert set(found) == {(int(i), name) for i, s in texts.items() for name, g in grams.items() if 100 * len(g & set(s)) >= 80 * len(g)}
    # A template set of any size, as a license text of thousands of words.
    own = {f"own{k}": " ".join(f"{chr(97 + k)}{i}" for i in range(3_000)) for k in range(4)}
    long = spark.createDataFrame([(1, f"{filler} {own['own2']} {filler}"), (2, " ".join(own["own1"].split()[:2_000]))], "doc_id int, text string")
    assert [(r["doc_id"], r["license"]) for r in scan(long, own).collect()] == [(1, "own2")]
    assert scan(odd).count() == 0 and scan(none).count() == 0
