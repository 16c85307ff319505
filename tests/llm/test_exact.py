"""Operators against brute force, the tokenizer libraries and round trips."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ontide.llm import bpe, decontaminate, license_scan, pii, piece_counts, prefix_tree_join
from ontide.llm import quality_rules, suffix_repeats, suffix_tree_lm, warc
from ontide.llm.common import table
from ontide.llm.oracles import ORACLES
from ontide.llm.queries import PIECES, QUERIES, WORD_BPE, tokenizer_path
from tests.compare import connect, difference


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None


# --- Quality rules


def test_quality_lines():
    def rule(line):
        data = line.encode()
        return quality_rules.line_judge(data, quality_rules.QualityParams())(data)

    assert rule("A sentence that ends well.") is None
    assert rule("He said: «no…» and left.") is None
    assert rule("Home About Contact") == "punctuation"
    assert rule("buy### now$$$ here%%% today.") == "punctuation"
    assert rule("Home | About. | Contact | Help.") == "navigation"
    assert rule("We use cookies to improve the site.") == "boilerplate"
    assert rule("THIS IS ALL VERY LOUD INDEED.") == "boilerplate"


def test_cleaned_text(spark):
    text = "A good line stands here and it ends well.\nHome | Help. | More\n\nAnother good line ends here as well."
    row = quality_rules.clean_documents(documents(spark, [text])).first()
    assert row["cleaned_text"] == text.replace("Home | Help. | More\n", "")
    assert row["kept"] and row["lines_navigation"] == 1


# --- Repeats


def brute_repeats(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("chunk", [256, 8])
def test_repeats_match_brute_force(spark, chunk):
    rng = random.Random(5)
    letters = "abcdefgh é"
    base = "".join(rng.choice(letters) for _ in range(4000))
    texts = []
    for _ in range(120):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 30, 500, 1500])))
        for _ in range(rng.choice([0, 1, 1, 2])):
            a = rng.randrange(3000)
            passage = base[a : a + rng.choice([300, 380, 399, 400, 401, 450, 900])]
            k = rng.randrange(len(text) + 1)
            text = text[:k] + passage + text[k:]
        texts.append(text)
    texts += ["a" * 2000, "xy" * 700, base[:900] * 2, base[:900] * 2, base[100:800] + "z", None]
    params = suffix_repeats.RepeatParams(chunk=chunk)
    rows = suffix_repeats.remove_repeats(documents(spark, texts), params, with_kept=True).collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in rows}
    wanted = brute_repeats([(t or "").encode() for t in texts], 400)
    assert [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, found[i])) for i in range(len(texts))] == wanted


@pytest.mark.parametrize("chunk", [256, 3])
def test_passage_in_many_texts_matches_brute_force(spark, chunk):
    """A hot hash: one passage, cut at both ends, in 2,000 texts, some of them equal around it."""
    rng = random.Random(6)
    letters = "abcdefgh é"

    def some(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, sides = some(440), [some(60) for _ in range(4)]
    texts = []
    for i in range(2000 if chunk > 100 else 60):
        left = rng.choice(sides)[rng.randrange(60) :] if i % 3 else some(rng.randrange(60))
        right = rng.choice(sides)[: rng.randrange(60)] if i % 4 else some(rng.randrange(60))
        texts.append(left + passage[rng.choice([0, 0, 0, 17, 39]) : rng.choice([440, 440, 425])] + right)
    params = suffix_repeats.RepeatParams(chunk=chunk)
    rows = suffix_repeats.remove_repeats(documents(spark, texts), params).collect()
    wanted = [row[:4] for row in brute_repeats([t.encode() for t in texts], 400)]
    assert [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])] == wanted


def test_rows_of_near_copies_grow_with_their_number(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    made = suffix_repeats.shared_rows
    found = []
    for copies in (60, 240):
        texts = []
        for _ in range(copies):
            at = rng.randrange(len(base))
            texts.append(base[:at] + rng.choice("ABCDEFGH") + base[at + 1 :])
        rows = []

        def counted(classes, length):
            shared = made(classes, length)
            rows.append((classes.count(), shared.count()))
            return shared

        monkeypatch.setattr(suffix_repeats, "shared_rows", counted)
        params = suffix_repeats.RepeatParams(chunk=8)
        out = suffix_repeats.remove_repeats(documents(spark, texts), params, with_kept=True).collect()
        got = [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")) for r in sorted(out)]
        assert got == brute_repeats([t.encode() for t in texts], 400)
        found.append((rows[0][0], sum(n for _, n in rows)))
    (few, few_rows), (many, many_rows) = found
    # a class has some rows in each of the nine rounds
    assert few_rows <= 40 * few and many_rows <= 40 * many, found


def test_prefix_intervals():
    found = set(suffix_repeats.prefix_intervals([2, 3, 1, 4]))
    assert found == {(3, 1, 2), (2, 0, 2), (4, 3, 4), (1, 0, 4)}


def test_segments_of_long_texts(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(9000))
    whole = suffix_repeats.anchors(data, 400)
    monkeypatch.setattr(suffix_repeats, "SEGMENT", 1024)
    cut = suffix_repeats.anchors(data, 400)

    def owners(columns):
        return {p: (h, a) for h, a, first, last in zip(*columns) for p in range(first, last + 1)}

    assert owners(whole) == owners(cut) and len(owners(whole)) == len(data) - 399


# --- Leaks


def test_leaks_in_blocks(spark, small):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    once = decontaminate.leak_report(decontaminate.find_leaks(docs, items))
    blocks = decontaminate.leak_report(decontaminate.find_leaks(docs, items, block_windows=150))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, blocks.collect()))


def test_window_search_matches_naive():
    rng = random.Random(2)
    words = [b"a", b"b", b"c"]
    for _ in range(300):
        windows = {
            tuple(rng.choices(words, k=rng.choice([10, 10, 3, 2, 1]))): [i] for i in range(rng.choice([1, 4]))
        }
        text = rng.choices(words, k=60)
        naive = {
            (i, w) for w in windows for i in range(len(text) - len(w) + 1) if tuple(text[i : i + len(w)]) == w
        }
        assert set(decontaminate.WindowSearch(windows).occurrences(text)) == naive


# --- Pieces


def test_pieces_match_library(spark, small):
    from tokenizers import Tokenizer, models, pre_tokenizers

    initial, inner = piece_counts.piece_vocabulary(tokenizer_path(PIECES))
    names = ["[UNK]", *sorted(initial), *("##" + p for p in sorted(inner))]
    model = models.WordPiece(
        {n: i for i, n in enumerate(dict.fromkeys(names))}, unk_token="[UNK]", max_input_chars_per_word=10**6
    )
    library = Tokenizer(model)
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    texts[-1] = "ab一鿿 \U0001f600 unaffable strange##word ## # a"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for row in piece_counts.count_pieces(docs, (initial, inner)).collect():
        assert row["n_tokens"] == len(library.encode(texts[row["doc_id"]]).ids), row


def test_spare_pieces_spell_every_word(spark, small):
    path = tokenizer_path(PIECES)
    (initial, inner), spare = piece_counts.piece_vocabulary(path), piece_counts.spare_pieces(path)
    assert spare.mark and len(spare.bytes) == 256

    def greedy(word):
        sizes = range(len(word), 0, -1)
        at = next((n for n in sizes if word[:n] in initial), 0)
        total = 1
        while at < len(word):
            n = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in inner), 0)
            total += 1 if n else len(word[at].encode())
            at += n or 1
        return total

    counter = piece_counts.PieceCounter(initial, inner, spare)
    assert counter.count("2024") == 5 and counter.count("\U000e0001") == 5
    words = ["7", "3.14", "ñción", "ß", "çok", "漢字かな", "한국어", "ab一鿿", "\U0001f600x", "a\U000e0001b", "ภาษา"]
    for row in table(spark, small, "documents").collect():
        words += row["text"].split()
    for word in set(words):
        assert counter.count(word) == greedy(word), word
    made = piece_counts.PieceCounter({"ab"}, {"xyz", "y", "c"}, piece_counts.SparePieces(True, frozenset(range(256))))
    assert [made.count(w) for w in ("ac", "abxyz", "abxyc", "xyz", "éab")] == [3, 2, 4, 2, 5]
    rows = QUERIES["op4_token_counts"](spark, small)
    assert rows.filter("n_unknown > 0").isEmpty()


# --- WARC


def test_archives_by_offset(spark, small, tmp_path):
    pages = table(spark, small, "pages")
    written = warc.write_archives(pages, f"file://{tmp_path}/whole", warc.WarcParams(file_bytes=50_000))
    written = spark.createDataFrame(written.collect(), written.schema)
    normal = warc.normalise_archives(written, f"file://{tmp_path}/whole", f"file://{tmp_path}/records")
    rows = normal.collect()
    assert sum(r["records"] for r in rows) == pages.count() and len(rows) > 1
    for row in rows:
        data, index = open(row["path"], "rb").read(), open(row["index"]).read().splitlines()
        whole = open(row["path"].replace("/records/", "/whole/"), "rb").read()
        members, rest = [], data
        while rest:
            engine = zlib.decompressobj(31)
            members.append(engine.decompress(rest))
            rest = engine.unused_data
        assert len(members) == len(index) == row["records"]
        assert b"".join(members) == zlib.decompress(whole, 31)


def test_records_in_small_pieces():
    data = [warc.record_bytes(i, f"u{i}", b"x" * (i * 37), "d", None, i, "2024") for i in range(5)]
    stream = io.BytesIO(b"".join(data))
    assert list(warc.records(iter(lambda: stream.read(7), b""))) == data
    with pytest.raises(ValueError):
        list(warc.records([data[0][:-5]]))


# --- Personal data


def brute_spans(text):
    out = [
        ("email", *m.span())
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    ]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_patterns(spark, small):
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("a@.1234+- ()b.%0é") for _ in range(40))
        assert pii.base_spans(text) == brute_spans(text), text
    for row in table(spark, small, "documents").collect():
        assert pii.base_spans(row["text"]) == brute_spans(row["text"])


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("write john at example dot com", "email", "john at example dot com"),
        ("mail jоhn＠exаmple.com", "email", "jоhn＠exаmple.com"),
        ("john@example dot co dot uk", "email", "john@example dot co dot uk"),
        ("call ＋１ 555 ２３４ 5678 9", "phone", "＋１ 555 ２３４ 5678 9"),
        ("+1 five five five one two three four five six", "phone", "+1 five five five one two three four five six"),
        ("card 4532​ 0151​ 1283​ 0366", "card", "4532​ 0151​ 1283​ 0366"),
        ("host １０.0.0.１ up", "ip", "１０.0.0.１"),
    ],
)
def test_disguises(text, kind, found):
    base, spans = pii.all_spans(text)
    assert [text[a:b] for k, a, b in spans if k == kind and (k, a, b) not in base] == [found]


@pytest.mark.parametrize("text", ["meet me at example.com", "one two buckle my shoe", "look at the dot there"])
def test_plain_text_stays(text):
    assert pii.all_spans(text) == ([], [])


def test_base_spans_stay():
    text = "a@b.de and c [at] d [dot] org"
    base, spans = pii.all_spans(text)
    assert set(base) < set(spans) and pii.masked(text, spans) == "<EMAIL> and <EMAIL>"


@pytest.mark.parametrize(
    "text",
    ["jane [dot] doe@example.com", "j\u0430ne@example.com", "jo\u0430n.doe@example.com", "john@example.co dot uk"],
)
def test_wider_spans_stand_beside_base_spans(text):
    base, spans = pii.all_spans("to " + text + ", soon")
    assert base and set(base) < set(spans) and ("email", 3, 3 + len(text)) in spans
    assert pii.masked("to " + text + ", soon", spans) == "to <EMAIL>, soon"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("john at example [dot] com", "email"),
        ("john [at] example dot com", "email"),
        ("jane dot doe at example dot com", "email"),
        ("jane dot m dot doe at example.com", "email"),
        ("jane dot doe@example.com", "email"),
        ("jane (dot) doe at mail dot example dot co dot uk", "email"),
        ("john at example dot tv", "email"),
        ("john at example dot xyz", "email"),
        ("john at example dot us", "email"),
        ("jane dot doe at example dot it", "email"),
        ("john99 at example dot in", "email"),
        ("john at mail dot example dot me", "email"),
        ("+1 (five five five) one two three - four five six seven", "phone"),
        ("plus one five five five one two three four five six seven", "phone"),
        ("+1 (five five five) 123-four five six seven", "phone"),
        ("four five three two-0151-one two eight three-0366", "card"),
        ("user[@]example[.]com", "email"),
        ("user(@)example.com", "email"),
        ("user [@] mail dot example [.] com", "email"),
        ("jane [.] doe {@} example(.)org", "email"),
        ("192[.]168[.]1[.]1", "ip"),
        ("192 dot 168 dot 1 dot 1", "ip"),
        ("192.168 [dot] 1 (.) 1", "ip"),
        ("one nine two dot one six eight dot one dot one", "ip"),
        ("one zero dot 0 dot two five five dot oh", "ip"),
    ],
)
def test_mixed_disguises(text, kind):
    text = f"see {text}; thanks"
    assert (kind, 4, len(text) - 8) in pii.all_spans(text)[1]


@pytest.mark.parametrize(
    "text",
    [
        "look at the dot in the middle",
        "look at the dot com bubble",
        "they stare at red dot in the sky",
        "one or two (three) of them in 2019, and 5 at home",
        "a dot at home and a dot at work",
        "plus one two three of these",
        "version 2 dot 10 dot 3 is out",
        "releases 1 dot 2 dot 3 dot 4 dot 5 and 7[.]1",
        "192 dot 168 dot 1 dot 256",
        "one two dot three dot four",
        "the end [.] and more (@) home",
    ],
)
def test_running_text_stays(text):
    assert pii.all_spans(text) == ([], [])


def test_disguises_are_linear():
    for piece in ("a dot ", "a at ", "one ", "1 (", "a at b dot c ", "a [dot] ", "@ dot ", "1 dot ", "one dot ", "1[.]"):
        pii.all_spans(piece * 50_000)


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 1000 + "+1" + "(" * 100_000) == []


# --- BPE


def test_bpe_matches_library(spark, small):
    from tokenizers import Tokenizer

    spec = bpe.read_spec(tokenizer_path(WORD_BPE))
    library, encoder = Tokenizer.from_str(spec), bpe.ChunkEncoder(spec)
    rng = random.Random(4)
    letters = "abcdeéèçñü'sStTx 0123.,!?#<|>’“ \n\tΣσİ日本́ ½ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 40, 4000]))) for _ in range(400)]
    texts += ["<|endoftext|>" * 300, "a<|startoftext|>b " * 200, "x" * 20_000, "", " \x0b\x1c a"]
    texts += [r["text"] for r in table(spark, small, "documents").collect()]
    for text in texts:
        ids = encoder.encode(text.encode())
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert encoder.reused and encoder.repaired


def without_blanks(kind, size):
    rng = random.Random(size)
    if kind == "stops":
        return "".join(rng.choice("中文字符国家人民我们的一是不了在有大这来。，、") for _ in range(size // 3))
    if kind == "ideographs":
        return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(size // 3))
    if kind == "base64":
        return base64.b64encode(rng.randbytes(size * 3 // 4)).decode()
    return "".join(rng.choice("abcdefghij") for _ in range(size))


KINDS_WITHOUT_BLANKS = ["stops", "ideographs", "base64", "letters"]


@pytest.mark.parametrize("kind", KINDS_WITHOUT_BLANKS)
def test_bpe_without_blanks(kind):
    from tokenizers import Tokenizer

    spec = bpe.read_spec(tokenizer_path(WORD_BPE))
    library, encoder = Tokenizer.from_str(spec), bpe.ChunkEncoder(spec)
    long = without_blanks(kind, 200_000)
    for text in (long, long[50_000:90_000], f"one {long[:30_000]} two {long[:20_000]}"):
        assert encoder.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", KINDS_WITHOUT_BLANKS)
def test_bpe_work_grows_with_the_text(kind):
    """Bytes that go through the encoder, chunks and joints together: the same multiple at every length."""
    spec = bpe.read_spec(tokenizer_path(WORD_BPE))
    for size in (30_000, 300_000):
        encoder, seen = bpe.ChunkEncoder(spec), []
        plain = encoder.encode_piece
        encoder.encode_piece = lambda data, plain=plain, seen=seen: seen.append(len(data)) or plain(data)
        data = without_blanks(kind, size).encode()
        encoder.encode(data)
        assert sum(seen) <= 3 * len(data)


def test_bpe_places_part_words_anywhere():
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(bpe.read_spec(tokenizer_path(WORD_BPE)))
    rng = random.Random(12)
    letters = "ab'st ré12\n9\u0301\u20e3½Σ中国人。，、!<|é"
    for _ in range(2_000):
        data = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))).encode()
        whole = library.encode(data.decode(), add_special_tokens=False).ids
        for at in bpe.parted(data).tolist():
            sides = [library.encode(side.decode(), add_special_tokens=False).ids for side in (data[:at], data[at:])]
            assert sides[0] + sides[1] == whole, (data.decode(), at)


def test_bpe_rows(spark):
    spec = bpe.read_spec(tokenizer_path(WORD_BPE))
    encoded = bpe.encode_documents(documents(spark, ["Hello world", None]), spec)
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, spec).collect()}
    assert decoded == {0: "hello</w> world</w>", 1: ""}


def test_equal_passages_are_cut_alike():
    rng = random.Random(6)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(30_000))

    def chunks(data):
        cuts = [0, *bpe.cut_points(data)]
        return {data[a:b] for a, b in zip(cuts, cuts[1:])}

    assert len(chunks(b"one " * 99 + passage) & chunks(passage + b" two")) > 5


# --- Jaccard join


def brute_components(sets, percent=90):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def shingles(text, width=3):
    words = (text or "").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def test_join_matches_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 9, 25, 120, 400]))
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: int(len(words) * rng.uniform(0.9, 1))]
            texts.append(" ".join(words) + (" " + shared if rng.random() < 0.3 else ""))
    texts += ["a", "A", "a b", "a B", "", None, "a a a a", "a a a"]
    wanted = brute_components({i: shingles(t) for i, t in enumerate(texts)})
    for params in (prefix_tree_join.JoinParams(), prefix_tree_join.JoinParams(chunk=3)):
        rows = prefix_tree_join.link_documents(documents(spark, texts), params).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == wanted
        assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]])) for r in rows)
    wanted = brute_components({i: shingles(t, 5) for i, t in enumerate(texts)}, 80)
    rows = prefix_tree_join.link_documents(documents(spark, texts), corpus_pipeline.NEAR).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == wanted
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]], 5)) for r in rows)


def test_parts_miss_no_link():
    rng = np.random.default_rng(8)
    cutter = prefix_tree_join.Parts(90)
    for n in (10, 19, 40, 90, 150, 700, 3000):
        for _ in range(40):
            values = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = rng.integers(0, n // 19 + 1)
            other = np.concatenate([values[drop:], rng.integers(0, 1 << 63, n // 19 - drop + 1, dtype=np.uint64)])
            other = np.unique(rng.permutation(other))
            shared = len(np.intersect1d(values, other))
            if 100 * shared >= 90 * (len(values) + len(other) - shared):
                assert set(cutter.keys(values)) & set(cutter.keys(other))


@pytest.mark.parametrize("percent", [30, 50, 66, 79, 80, 90])
def test_parts_meet_at_any_percent(percent):
    rng = np.random.default_rng(9)
    cutter = prefix_tree_join.Parts(percent)
    for n in [*range(1, 60), 200, 1000]:
        longest = 100 * n // percent
        for size in {longest, (n + longest) // 2}:
            other = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            values = np.sort(rng.permutation(other)[:n])
            assert set(cutter.keys(values)) & set(cutter.keys(other)), (n, size)
            assert share_enough(cutter, values, other), (n, size)


def share_enough(cutter, *sets):
    """Whether in some class both sets have in common as many keys as each of them needs."""
    one, two = ({number: (set(keys), need) for number, keys, need in cutter.classes(s)} for s in sets)
    return any(len(one[c][0] & two[c][0]) >= max(one[c][1], two[c][1]) for c in one.keys() & two.keys())


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_enough_keys(percent):
    rng = np.random.default_rng(10)
    cutter = prefix_tree_join.Parts(percent)
    found = 0
    for _ in range(1500):
        n = int(rng.choice([2, 5, 9, 24, 60, 200, 900]))
        values = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        kept = values[rng.random(len(values)) < rng.choice([0.7, 0.85, 0.95, 1.0])]
        new = rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64)
        other = np.unique(np.concatenate([kept, new]))
        shared = len(np.intersect1d(values, other))
        if len(other) and 100 * shared >= percent * (len(values) + len(other) - shared):
            found += 1
            assert share_enough(cutter, values, other)
    assert found > 100


def test_counts_and_members_of_keys_move_one_after_the_other(spark, monkeypatch):
    plans, stage = [], prefix_tree_join.stage

    def staged(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df)

    monkeypatch.setattr(prefix_tree_join, "stage", staged)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "end"]), "other words stand here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = prefix_tree_join.link_documents(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 0, 2: 2}
    assert max(plan.count("Generate explode(keys") for plan in plans) == 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in prefix_tree_join.components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- Licenses


def test_license_scan_is_native(spark, small):
    plan = license_scan.scan_licenses(table(spark, small, "documents"))
    text = plan._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def test_every_template_is_found(spark):
    filler = " ".join(f"word{i}" for i in range(40))
    texts = [f"{filler} {body} {filler}" for body in license_scan.TEMPLATES.values()]
    rows = license_scan.scan_licenses(documents(spark, texts)).collect()
    found = {(r["doc_id"], r["license"]) for r in rows if r["containment"] == 1}
    assert {(i, name) for i, name in enumerate(license_scan.TEMPLATES)} <= found


# --- Suffix tree


def brute_tree_scores(texts, held, params):
    """The tree and its scores from plain counts, as the module states them."""
    tokens = [[*(t or "").lower().encode().split(), b""] for t in texts]
    train = [t for t, out in zip(tokens, held) if not out]
    counts = Counter(w for t in train for w in t)
    total, distinct = sum(counts.values()), len(counts)
    frequent = {w for w, c in counts.items() if c >= params.least_share * total}
    sizes, nexts = [dict(), {(w,): counts[w] for w in frequent}], [None, defaultdict(Counter), defaultdict(Counter)]
    for t in train:
        for i in range(1, len(t)):
            if t[i - 1] in frequent and t[i] in frequent:
                nexts[1][t[i - 1],][t[i]] += 1
    listed = {1: {}, 2: {}}
    least = params.least_pair_share * total
    listed[1] = {s: {x: n for x, n in c.items() if n >= least} for s, c in nexts[1].items()}
    sizes.append(
        {(*s, x): n for s, c in listed[1].items() for x, n in c.items() if n >= params.least_share * total and x}
    )
    for t in train:
        for i in range(2, len(t)):
            if (t[i - 2], t[i - 1]) in sizes[2] and t[i] in frequent:
                nexts[2][t[i - 2], t[i - 1]][t[i]] += 1
    listed[2] = {s: {x: n for x, n in c.items() if n >= least} for s, c in nexts[2].items()}
    states = {}
    for depth in (1, 2):
        for s, c in listed[depth].items():
            def parent(x):
                if depth == 1:
                    return counts[x] / total
                n = listed[1].get(s[1:], {}).get(x)
                return params.least_pair_share if n is None else n / sizes[1][s[1:]]

            gain = sum(n * math.log(n / sizes[depth][s] / parent(x)) for x, n in c.items())
            if c and gain >= params.divergence:
                states[s] = c
    for s in [s for s in states if len(s) == 2]:
        states.setdefault(s[1:], listed[1].get(s[1:], {}))

    def share(context, x):
        if not context:
            return (counts[x] + 1) / (total + distinct + 1)
        shorter = share(context[1:], x)
        if context not in states:
            return shorter
        size = sizes[len(context)][context]
        own = {y: max(n - params.discount, 0) / size for y, n in states[context].items()}
        return own.get(x, 0) + (1 - sum(own.values())) * shorter

    def longest(t, i):
        return tuple(t[max(0, i - 2) : i])

    base = [sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t) for t in tokens]
    score = [sum(math.log10(share(longest(t, i), w)) for i, w in enumerate(t)) for t in tokens]
    every = [*counts, b"never seen"]
    for context in [(), *list(states)[:20]]:
        assert abs(sum(share(context, x) for x in every) - 1) < 1e-9
    return total, base, score, states


def test_tree_matches_brute_force(spark):
    rng = random.Random(9)
    chain = {w: rng.choices("abcdefghij", k=3) for w in "abcdefghij"}
    texts = []
    for _ in range(220):
        word, out = rng.choice("abcdefghij"), []
        for _ in range(rng.choice([0, 1, 2, 30, 80])):
            out.append(word.upper() if rng.random() < 0.1 else word)
            word = rng.choice(chain.get(word, "abc")) if rng.random() < 0.85 else rng.choice("abcdefghijxyz")
        texts.append(" ".join(out))
    params = suffix_tree_lm.TreeParams(least_share=0.002, least_pair_share=0.0004, divergence=6.0)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    total, base, score, states = brute_tree_scores(texts, held, params)
    assert {len(s) for s in states} == {1, 2}
    rows = {r["doc_id"]: r for r in suffix_tree_lm.score_documents(documents(spark, texts), params).collect()}
    for i in range(len(texts)):
        assert rows[i]["held_out"] == held[i] and rows[i]["train_tokens"] == total
        assert rows[i]["base_score"] == pytest.approx(base[i], rel=1e-9)
        assert rows[i]["score"] == pytest.approx(score[i], rel=1e-9)
    out = [i for i in range(len(texts)) if held[i]]
    assert sum(score[i] for i in out) > sum(base[i] for i in out)


def test_tree_keeps_contexts_of_a_large_corpus(spark):
    """A context that is rare among all tokens is a state, whatever the size of the corpus."""
    rng = random.Random(10)
    texts = ["quartz lamp glows green"] * 40 + [" ".join(f"w{rng.randrange(60)}" for _ in range(2000)) for _ in range(300)]
    rows = {r["doc_id"]: r for r in suffix_tree_lm.score_documents(documents(spark, texts)).collect()}
    assert rows[0]["train_tokens"] > 40 * 10_000
    # three of the five tokens follow a context that leaves no choice, but for the discount
    assert all(rows[i]["score"] > rows[i]["base_score"] + 12 for i in range(40))


def test_tree_depth(spark):
    """Only three words before tell which word follows."""
    rng = random.Random(11)
    texts = []
    for _ in range(600):
        first = rng.choice("ab")
        texts.append(f"{first} m n {'x' if first == 'a' else 'y'}")
    scores = []
    for depth in (2, 3):
        params = suffix_tree_lm.TreeParams(depth=depth)
        rows = suffix_tree_lm.score_documents(documents(spark, texts), params).collect()
        scores.append(sum(r["score"] for r in rows) / len(rows))
    assert scores[1] > scores[0] + 0.25


# --- Pipeline


def test_pipeline_matches_brute_force(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    docs = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    cleaned = {
        r["doc_id"]: r["cleaned_text"]
        for r in quality_rules.clean_documents(documents_of(spark, docs)).collect()
        if r["kept"]
    }
    component = brute_components({d: shingles(t, 5) for d, t in cleaned.items()}, 80)
    unique = {d: t for d, t in cleaned.items() if component[d] == d}
    windows = set()
    for row in table(spark, small, "benchmark").collect():
        words = decontaminate.item_words(row["text"].encode())
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()
    clean = {}
    for d, t in unique.items():
        words = decontaminate.item_words(t.encode())
        grams = {tuple(words[i : i + k]) for k in {len(w) for w in windows} for i in range(len(words) - k + 1)}
        if not grams & windows:
            clean[d] = t
    masked = {d: pii.masked(t, pii.all_spans(t)[1]) for d, t in clean.items()}
    wanted = {d: library.encode(t, add_special_tokens=False).ids for d, t in masked.items()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == wanted
    assert len(docs) > len(cleaned) > len(unique) >= len(clean) > 0


def documents_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
