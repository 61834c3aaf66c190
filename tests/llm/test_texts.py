"""Encoding, packing and garbled text on small tables."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinnabar.llm import bpe, mojibake, packing

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, ids string, tokens string, key string"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["a"] * len(texts))[i], "i", "t", "k") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n  x", "<|endoftext|>", "don't we'll I'VE", "é" * 50, "日本語のテスト。", "a b c​", "x" * 5000, "ab" * 3000 + "!", "\t\t\r\n \x0b \x1c\x1f\x85", "𝛼🧪👍🏽", "1234567890" * 40, "٣٤ ½ Ⅷ", "\x00\x01\x7f"]


def test_ids_are_the_vocabularys(spark, reference):
    texts = [*ODD, None]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(frame(spark, texts)).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    lengths = {r["doc_id"]: r["tokens"] for r in bpe.encode(frame(spark, texts), lengths=True).collect()}
    assert lengths == {i: len(x) for i, x in got.items()}
    assert bpe.encode(frame(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_any_text(reference, text):
    own = bpe.encoder(bpe.default_vocabulary())
    assert own.encode(text) == reference.encode_ordinary(text)


def test_long_words_merge_alike(reference):
    own = bpe.encoder(bpe.default_vocabulary())
    rng = random.Random(1)
    for n in (201, 500, 2000):
        word = bytes(rng.choice(b"abcdeinorst") for _ in range(n))
        assert own.long_word(word) == reference.encode_ordinary(word.decode())


def check_packing(rows, sizes, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == sizes.keys()
    for k, pieces in by.items():
        pieces.sort(key=lambda r: r["piece"])
        assert sum(r["tokens"] for r in pieces) == sizes[k] and [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == 1 or sizes[k] > capacity and all(r["tokens"] == capacity for r in pieces[:-1])
    boxes = {}
    for r in rows:
        boxes.setdefault(r["container"], []).append((r["place"], r["tokens"]))
    for items in boxes.values():
        end = 0
        for place, n in sorted(items):
            assert place == end
            end += n
        assert end <= capacity
    return boxes


def best_fit(sizes, capacity):
    """Containers that plain best fit needs, given all items at once, largest first: a packer without windows and mixture."""
    spaces = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, s in enumerate(spaces) if s >= n]
        if fits:
            spaces[min(fits, key=spaces.__getitem__)] -= n
        else:
            spaces.append(capacity - n)
    return len(spaces)


def test_packing(spark, monkeypatch):
    rng = random.Random(6)
    sizes = {i: rng.choice([0, 1, 5, 40, 63, 64, 65, 200]) if i % 9 == 0 else rng.randint(1, 60) for i in range(3000)}
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), n, "x", "y") for i, n in sizes.items()]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int, piece string, container string")
    for partition, loss in ((2500, 1.01), (200, 1.025)):  # what windows of one mixture and small partitions may cost
        monkeypatch.setattr(packing, "PARTITION", partition)
        boxes = check_packing(packing.pack(df, capacity=64).collect(), sizes, 64)
        assert len(boxes) <= loss * best_fit([x for n in sizes.values() for x in [64] * (max(0, n - 1) // 64) + [n - 64 * (max(0, n - 1) // 64)]], 64)
    assert packing.pack(df.limit(0)).count() == 0


def test_windows_keep_the_proportions():
    rng = random.Random(2)
    source = ["big"] * 4000 + ["small"] * 1000
    tokens = [rng.randint(5, 200) for _ in source]
    total = {s: sum(n for x, n in zip(source, tokens) if x == s) for s in set(source)}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    out = packing.fill(source, tokens, share, {}, 1024, 16)
    window = {}
    for n, (i, _, box, _, size) in enumerate(out):
        w = window.setdefault(n * 16 // len(out), {"big": 0, "small": 0})
        w[source[i]] += size
    for w in window.values():
        assert abs(w["small"] / (w["small"] + w["big"]) - share["small"]) < 0.06


def test_many_sources_keep_their_shares(spark, monkeypatch):
    """Fifteen hundred sources, of which two are asked for in proportions that the table doesn't have."""
    monkeypatch.setattr(packing, "PARTITION", 60)
    rows = [(i, f"s{i % 1500}", 10) for i in range(3000)] + [(10_000 + i, "much", 16) for i in range(3000)] + [(20_000 + i, None, 16) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    got = packing.pack(df, capacity=64, shares={"much": 0.3, None: 0.1, **{f"s{i}": 0.6 / 1500 for i in range(1500)}}).collect()
    check_packing(got, {k: n for k, _, n in rows}, 64)
    # what was asked for most comes first, in every partition
    source = {k: s for k, s, _ in rows}
    early = [source[r["doc_id"]] for r in got if r["container"] & 0xFFFFFFFF < 20]
    assert early.count("much") > 2 * early.count(None) > 0


def test_packed_texts(spark):
    texts = ["hello world"] * 20 + ["word " * 3000, None, ""]
    rows = packing.pack_texts(frame(spark, texts)).collect()
    own = bpe.encoder(bpe.default_vocabulary())
    check_packing(rows, {i: len(own.encode(t)) for i, t in enumerate(texts)}, 2048)


CLEAN = [
    "Die Größe wäre trüb, wenn wir sie früher prüfen.",
    "Schöne Grüße aus dem Labor, bis später.",
    "On a chauffé deux fois, rien de régulier à la ligne.",
    "Même problème ici, le réacteur a été filtré trop tôt.",
    "You’ll need “fresh” solvent – it’s the pump, not the gasket.",
    "The probe read 45 °C and 12 µL at 3 kΩ.",
    "Похоже, образец тут ни при чём, раствор был сухой.",
    "Вчера я проверил фильтр, а он опять чистый.",
]
TRAPS = ["ÄÖÜ – Gefäß Ä“, Spalte Ü‚ß‘", "Â = Û·Â† (Operatoren)", "AVELÃ® e HORTELÃ™ (marcas)", "SÃO dois: CORAÇÃO e PRESSÃO", "½ × ¾ ≈ ⅜", "caf&eacute; \\u00e9 %C3%A9", "plain ascii", "Þórð og Æsa, ð og þ", "日本語のテスト"]


def corpus():
    """Every clean line in many posts beside different words, so that its letters are known."""
    rng = random.Random(9)
    return [f"{rng.choice(CLEAN)} {rng.choice(CLEAN)} ({i})\n{CLEAN[i % 8]}" for i in range(400)]


def bad(text, written, read, times=1):
    for _ in range(times):
        text = mojibake.garbled(text, written, read)
    return text


def test_garbled_texts_are_found_and_restored(spark):
    texts = corpus()
    first = len(texts)
    cases = [
        bad(CLEAN[0], "utf-8", "cp1252"),
        bad(CLEAN[2], "utf-8", "latin-1"),
        bad(CLEAN[3], "utf-8", "cp1252", 2),
        bad(CLEAN[4], "utf-8", "cp437"),
        "> " + bad(CLEAN[6], "cp1251", "cp1252"),
        bad(CLEAN[7], "utf-8", "cp1251"),
        CLEAN[1] + "\n" + bad(CLEAN[5], "utf-8", "mac-roman"),
        bad("Ganz neu: die Größe wäre später trüb.", "utf-8", "cp1252"),
        "The caf� downstairs",
    ]
    texts += cases
    after = len(texts)
    texts += TRAPS * 3 + [None, "", " "]
    df = frame(spark, texts)
    assert {r["doc_id"] for r in mojibake.affected(df).collect()} == set(range(first, after))
    got = {r["doc_id"]: r["restored"] for r in mojibake.restored(df).collect()}
    assert [got[first + i] for i in range(8)] == [CLEAN[0], CLEAN[2], CLEAN[3], CLEAN[4], "> " + CLEAN[6], CLEAN[7], CLEAN[1] + "\n" + CLEAN[5], "Ganz neu: die Größe wäre später trüb."]


def test_few_characters_of_a_transformation_that_no_twin_shows():
    lines = [x for t in corpus() for x in t.split("\n")]
    counts = np.zeros(2 * mojibake.TABLE, np.int64)
    mojibake.count_lines(lines, [4 * mojibake.UNIT] * len(lines), counts)
    judge = mojibake.Judge(counts, [])
    for written in ("mac-roman", "cp850"):
        for text in ("Wenn wir sie prüfen.", "Schöne Größe.", "Die Größe wäre trüb."):
            assert judge.restored(bad(text, written, "cp1252")) == (True, text, False, True)
    assert not any(judge.restored(x)[0] for x in CLEAN + TRAPS + ["Ä ok", "a ½ b", "½ wäre", "Æsa"])


def test_correct_lines_of_many_texts_are_left_alone(spark):
    """Lines that look like what garbling leaves, each in many texts; one of them was garbled once more in a few."""
    rows = ["Ð (eth), Ñ (eñe)", "€ £ ¥ ¢ ¤", "AVELÃ® e HORTELÃ™ (marcas)", "Zwischen <b>ändert</b> sich die Größe kaum."]
    texts = corpus() + [f"{x}\n{CLEAN[i % 8]}" for x in rows for i in range(30)]
    first = len(texts)
    texts += [bad(rows[2], "utf-8", "cp1252"), bad(rows[2], "utf-8", "mac-roman")]
    assert {r["doc_id"] for r in mojibake.affected(frame(spark, texts)).collect()} == {first, first + 1}


JAPANESE = ["昨日、新しい触媒を混ぜました。", "たぶん溶液ではなく濾紙が黄色いです。", "97行目の結果を誰か調べましたか？"]


def test_second_bytes_in_ascii(spark):
    """Two-byte encodings whose second byte may be ASCII leave no twin with the same ASCII characters."""
    texts = corpus() + [f"{JAPANESE[i % 3]}{JAPANESE[(i + i // 3) % 3]} ({i})" for i in range(200)]
    first = len(texts)
    texts += [bad(x, "cp932", "cp1252") for x in JAPANESE]
    got = {r["doc_id"]: r["restored"] for r in mojibake.restored(frame(spark, texts)).collect()}
    assert got == {first + i: x for i, x in enumerate(JAPANESE)}


def test_short_lines_are_twins_where_their_texts_are(spark):
    """Lines of a few ASCII characters, garbled in a way that nothing else shows."""
    russian = ["Вчера я проверил фильтр", "Похоже, образец сухой", "Спасибо, раствор чистый"]
    texts = [f"{russian[i % 3]}\nsample number {i} was left alone\n{russian[(i + 1) % 3]}" for i in range(60)]
    first = len(texts)
    texts += [f"{bad(russian[i % 3], 'cp1251', 'cp1252')}\nsample number {i} was left alone\n{bad(russian[(i + 1) % 3], 'cp1251', 'cp1252')}" for i in range(4)]
    got = {r["doc_id"]: (r["restored"], r["shown"]) for r in mojibake.restored(frame(spark, texts)).collect()}
    assert got == {first + i: (texts[i], True) for i in range(4)}


def test_each_line_keeps_its_break(spark):
    texts = corpus()
    first = len(texts)
    texts.append(f"plain\r\n{bad(CLEAN[0], 'utf-8', 'cp1252')}\n\r\n{CLEAN[1]}\rend\r\n")
    got = {r["doc_id"]: r["restored"] for r in mojibake.restored(frame(spark, texts)).collect()}
    assert got == {first: f"plain\r\n{CLEAN[0]}\n\r\n{CLEAN[1]}\rend\r\n"}


def test_pieces_and_transformations():
    assert mojibake.pieces(("ä€",), "utf-8", "cp1252", 1) == {("Ã¤", "ä"), ("â‚¬", "€")}
    assert mojibake.pieces(("ä",), "utf-8", "cp1252", 2) == {("Ã¤", "ä"), ("Ãƒ", "Ã"), ("Â¤", "¤")}
    assert mojibake.cover({"utf-8>cp1252 utf-8>cp1254": 5, "utf-8>cp1254 utf-8>latin-1": 1, "utf-8>cp1252": 1}) == [("utf-8", "cp1252"), ("utf-8", "latin-1")]


def test_counts_are_those_of_single_lines():
    lines = ["Größe der Säule: 45 °C", "é", "à la «ligne» ½", "日本語のテスト", "Größe Größe", ""]
    many = np.zeros(2 * mojibake.TABLE, np.int64)
    mojibake.count_lines(lines, [1, 2, 3, 4, 5, 6], many)
    want = np.zeros_like(many)
    for x, n in zip(lines, [1, 2, 3, 4, 5, 6]):
        own = {i for w in mojibake.words(x) for i in mojibake._word(w)} | {mojibake._character(c) for c in x if c > "\x7f"}
        t = "\n" + x + "\n"
        own |= {mojibake._pair(p, q) for p, q in zip(t, t[1:]) if max(p, q) > "\x7f"}
        want[list(own)] += n
    assert (many == want).all()
    mojibake.count_lines([], [], many)


def test_planted_garbling_is_found(spark):
    """Recall and precision on texts garbled here, of which a third has no twin."""
    rng = random.Random(11)
    words = [w for x in CLEAN for w in x.split()]
    texts, planted = [], set()
    for i in range(1500):
        x = f"{CLEAN[i % 8]} {' '.join(rng.sample(words[(i % 4) * 12 : (i % 4) * 12 + 14], 8))} {i // 2}"
        if i % 9 == 0:
            y = bad(x, *rng.choice([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437")]), rng.choice([1, 1, 1, 2]))
            if i % 27:
                texts.append(x)
            planted.add(len(texts))
            texts.append(y)
        else:
            texts.append(x)
    got = {r["doc_id"] for r in mojibake.affected(frame(spark, texts)).collect()}
    assert len(got & planted) >= 0.98 * len(planted) and len(got - planted) <= 0.02 * len(planted)


def test_no_texts(spark):
    assert mojibake.affected(frame(spark, [])).count() == 0
    assert mojibake.affected(frame(spark, [None, "", "x" * 100_000, "é" * 50_000])).count() == 0


def test_transformations_are_inferred_from_twins():
    for w, r, n in (("utf-8", "cp1252", 1), ("utf-8", "latin-1", 2), ("cp1251", "cp1252", 1), ("utf-8", "cp850", 1)):
        line = CLEAN[6] if w == "cp1251" else CLEAN[0]
        assert (w, r, False) in mojibake.transformations(line, bad(line, w, r, n))
    assert mojibake.transformations("é a", "é a") == [] and mojibake.transformations("é a", "b é") == []
