"""Operators against brute force, round trips and held-out accuracy, without Spark."""

import binascii
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cliplane.llm import decontaminate, hilbert, langid, licenses, simhash, tokens, toxicity, warc, webp, webp_decode

DATA = "/root/testdata/sf0.1"


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def test_words_and_hashes():
    texts = ["", None, "Ab c", "é!x  0123456789abcdefghij", "zz"]
    data, off = tokens.flat(pa.array(texts))
    low = tokens.LOWER[data]
    s, e, first = tokens.spans(low, off, tokens.WORD)
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert tokens.hashes(low, s, e).tolist() == [tokens.word_hash(w) for w in flat]


def brute_hits(texts, items, w):
    win = {}
    for i, t in items:
        x = words(t)
        for k in range(max(1, len(x) - w + 1) if x else 0):
            win.setdefault(tuple(x[k : k + w]), set()).add(i or "")
    out = []
    for t in texts:
        x = words(t)
        hit, ids = [0] * len(x), set()
        for n in {len(k) for k in win}:
            for k in range(len(x) - n + 1):
                if o := win.get(tuple(x[k : k + n])):
                    ids |= o
                    hit[k : k + n] = [1] * n
        out.append((len(x), sum(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_decontamination(seed):
    rng = random.Random(seed)
    voc = "a b c dé e".split()
    items = [(str(i), " ".join(rng.choice(voc) for _ in range(rng.choice([0, 1, 2, 3, 16, 30])))) for i in range(4)] + [(None, "a"), ("x", None)]
    texts = [" ".join(rng.choice([*voc, "zz"]) for _ in range(rng.randint(0, 60))) for _ in range(6)] + [None, "", items[3][1] + " zz " + items[0][1], items[3][1], items[3][1]]
    w = rng.choice([2, 3, 13])
    c = decontaminate._columns(pa.array(texts, pa.string()), decontaminate.Phrases([i or "" for i, _ in items], [t for _, t in items], w))
    assert list(zip(c[0].to_pylist(), c[1].to_pylist(), c[2].to_pylist(), strict=True)) == brute_hits(texts, items, w)
    assert [sum(s["end"] - s["start"] for s in x) for x in c[3].to_pylist()] == c[1].to_pylist()


def test_phrases_are_compared_byte_by_byte(monkeypatch):
    """With a hash that mixes up all words of one length only true occurrences are left."""
    monkeypatch.setattr(tokens, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(50))
    p = decontaminate.Phrases(["a", "b"], ["a two seven", "fooled"], 3)
    c = decontaminate._columns(pa.array(["x a two seven a", "b two seven fooled", "a one seven", "a two seve"]), p)
    assert c[1].to_pylist() == [3, 1, 0, 0]
    with pytest.raises(ValueError):
        decontaminate.Phrases(["a"], ["one two"], 3)


def test_phrases_size():
    rng = random.Random(1)
    texts = [" ".join("%x" % rng.getrandbits(20) for _ in range(200)) for _ in range(300)]
    sent = decontaminate.Phrases([str(k) for k in range(300)], texts).sent()
    assert 0.9 * sum(map(decontaminate.most_sent, texts)) < sent <= sum(map(decontaminate.most_sent, texts))


def test_hilbert_neighbours():
    n, bits = 3, 3
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_license_automaton():
    a = licenses.Automaton('permission <<beginOptional;name="x">>is hereby<<endOptional>> granted to <<var;name="who";original="<year>";match=".{1,5}">> now <<var;match="ok|very well|">>')
    run = lambda t: a.longest(licenses.words_of(t.encode()), 0)
    assert run("Permission granted to a now ok") == 6
    assert run("permission is hereby granted to a b c now very well, x") == 11
    assert run("permission granted to abcde now") == 5
    assert run("permission is granted to a now ok") is None
    assert run("permission granted to abcdef now ok") is None
    assert run("permission granted to now ok") is None
    assert licenses.Automaton('version <<var;match="[0-9]+( [0-9])?">> end').longest([b"version", b"12", b"0", b"end"], 0) == 4
    assert licenses.Automaton('version <<var;match="[0-9]+">> end').longest([b"version", b"x", b"end"], 0) is None
    for n in (41, 10_000):
        free = [b"by", *[b"w%d" % k for k in range(n)], b"end"]
        assert licenses.Automaton('by <<var;match=".+">> end').longest(free, 0) == n + 2
        assert licenses.Automaton('by <<var;match=".{0,100000}">> end').longest(free, 0) == n + 2
    for bad in ("a <<endOptional>>", "a <<beginOptional>> b", "a <<what>>", 'a <<var;name="x">>', '<<var;match=".+">> a', "a <<var;match=b>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


@pytest.mark.parametrize("seed", range(60))
def test_license_passages_against_regex(seed):
    """The same template as a regular expression over words, tried on every pair of ends."""
    rng = random.Random(seed)
    pick = lambda: rng.choice("abcd")
    markup, plain = ["a"], ["a "]
    for _ in range(rng.randint(1, 5)):
        kind = rng.randint(0, 4)
        if kind == 0:
            w = pick()
            markup.append(w)
            plain.append(w + " ")
        elif kind == 1:
            w, v = pick(), pick()
            markup.append(f"<<beginOptional>>{w} <<beginOptional>>{v}<<endOptional>><<endOptional>>")
            plain.append(f"(?:{w} (?:{v} )?)?")
        elif kind == 2:
            w, v = pick(), pick()
            markup.append(f'<<var;match="{w}|{v} {w}">>')
            plain.append(f"(?:{w} |{v} {w} )")
        elif kind == 3:
            markup.append('<<var;match=".+">>')
            plain.append("(?:[a-d] )+")
        else:
            n = rng.randint(0, 3)
            markup.append('<<var;match=".{%d,%d}">>' % (n, n + 3))
            plain.append("(?:[a-d] ){%d,%d}" % ((n + 2) // 2, (n + 4) // 2))  # n words have 2 n - 1 characters
    words = [rng.choice("abcd") for _ in range(rng.randint(1, 25))]
    full = re.compile("".join(plain))
    want, until = [], 0
    for i in range(len(words)):
        ends = [j for j in range(i + 1, len(words) + 1) if full.fullmatch("".join(w + " " for w in words[i:j]))]
        if ends and i >= until:
            until = max(ends)
            want.append((i, until))
    a = licenses.Automaton(" ".join(markup))
    raw = [w.encode() for w in words]
    assert a.passages(raw, [i for i, w in enumerate(raw) if w in a.starts]) == want


def test_license_endings_count():
    """Whole wordings are accepted, changed or missing endings are not."""
    scan = licenses.Scanner().scan
    fill = {".{1,1000}": "some owner", "[123]": "3", "[123]( [01])?": "2 0", "[1-4]": "4", ".{1,120}": "mit"}
    for label, template in licenses.TEMPLATES.items():
        if "https" in template:
            continue
        text = licenses._TAG.sub(lambda m: "" if m[1] != "var" else (lambda x: fill.get(x, x.split("|")[0]))(dict(licenses._FIELD.findall(m[2]))["match"]), template).encode()
        assert label in {x[2] for x in scan(b"Copyright 2020 X. " + text + b" and more")[1]}
        if label.endswith("-text"):
            words = licenses.words_of(text)
            assert label not in {x[2] for x in scan(b" ".join(words[:-1]))[1]}
            assert label not in {x[2] for x in scan(b" ".join([*words[:-9], b"never", *words[-9:]]))[1]}
    assert not scan(b"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: you pay me")[1]


def test_license_tags_name_their_licenses():
    def labels(text):
        return {label: (a, b) for a, b, label, _ in licenses.Scanner().scan(text.encode())[1]}

    two = labels("SPDX-License-Identifier: MIT some words SPDX-License-Identifier: GPL-2.0-or-later")
    assert two == {"spdx-mit": (0, 4), "spdx-gpl-2-0": (6, 14)}
    both = labels("// SPDX-License-Identifier: (MIT OR Apache-2.0) */ int x;")
    assert both == {"spdx-mit": (0, 4), "spdx-apache-2-0": (0, 8)}
    assert labels("SPDX-License-Identifier: nothing known") == {}


def test_license_columns():
    text = ["Released under the MIT License. mit-license", None, "", "licensed under the apache license version 2.0", "general public license"]
    c = [x.to_pylist() for x in licenses.Scanner().columns(pa.array(text, pa.string()))]
    assert c[0] == [7, 0, 0, 8, 3]
    assert c[1] == [2, 0, 0, 1, 1]
    assert c[2] == [3, None, None, 3, 0] and c[3] == [5, None, None, 3, 0]
    assert c[4] == ["mit", "", "", "apache", "gpl"]
    assert c[5] == ["mit,mit-notice", "", "", "apache,apache-2.0-notice", "gpl"]
    assert c[6] == [5 / 9, 0.0, 0.0, 7 / 11, 3 / 7]


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def test_isotonic():
    k, v = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert v.tolist() == [0, 0, 0.5, 0.5, 1, 1] and k.tolist() == [1, 1, 2, 3, 4, 4]


def test_language(documents):
    held = [r for r in documents if binascii.crc32(str(r["doc_id"]).encode()) % 3 == 1][:800]
    train = [r for r in documents if binascii.crc32(str(r["doc_id"]).encode()) % 3 != 1][:1200]
    langs = sorted({r["lang"] for r in train})
    count = np.stack([sum(langid.tally(pa.array([r["text"]])) for r in train if r["lang"] == x) for x in langs])
    model = langid.Model.of(langs, count)
    got = langid.label(pa.array([r["text"] for r in held]), model)[0].to_pylist()
    assert np.mean([a == r["lang"] for a, r in zip(got, held, strict=True)]) > 0.99
    none = [None, "", "12 !?", "\u096a\u096b", "\u17e1\u17e2", "\u2160 \u20ac", "\u0301"]  # digits, number forms, signs and marks are no letters
    some = ["Ελληνικά", "\u2135", "\u00aa", "\u4e2d", "5\u00e9", "\U00010400"]
    odd = langid.label(pa.array(none + some, pa.string()), model)[0].to_pylist()
    assert odd[: len(none)] == ["und"] * len(none) and all(x in model.langs for x in odd[len(none) :])
    mixed = [held[0]["text"][:300] + " " + next(r for r in held if r["lang"] != held[0]["lang"])["text"][:300]] + [r["text"][:2000] for r in held[:20]]
    w = langid.Words(pa.array(mixed))
    path = model.paths(w)
    score = model.word_scores(w).astype(float)
    for d in range(len(mixed)):
        s = score[w.first[d] : w.first[d + 1]]
        v, back = s[0], []
        for x in s[1:]:
            m = np.where(np.eye(len(v)) > 0, v[:, None], v[:, None] - langid.PENALTY)
            back.append(m.argmax(0))
            v = m.max(0) + x
        p = [int(v.argmax())]
        for b in back[::-1]:
            p.append(int(b[p[-1]]))
        mine = path[w.first[d] : w.first[d + 1]]

        def total(way, s=s):
            return sum(s[i, x] for i, x in enumerate(way)) - langid.PENALTY * sum(a != b for a, b in zip(way, way[1:], strict=False))

        assert total(mine.tolist()) == pytest.approx(total(p[::-1]), rel=1e-5)  # ties may take another way of the same worth


def test_language_without_rows():
    model = langid.Model([], np.zeros((langid.BUCKETS, 0)), np.zeros((0, len(langid.SCRIPTS)), bool))
    assert langid.label(pa.array(["abc"]), model)[0].to_pylist() == ["und"]


def test_fingerprint():
    import xxhash

    for t in (b"", b" \t", b"One", b"a b", b"A b c a b c\x0bd \xc3\xa9"):
        w = t.lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(t) == want


@pytest.mark.parametrize("seed", range(150))
def test_webp_round_trip(seed):
    rng = np.random.default_rng(seed)
    h, w, tile, n = int(rng.integers(1, 20)), int(rng.integers(1, 20)), int(rng.integers(2, 4)), int(rng.choice([1, 2, 3, 10, 100, 0]))
    x = rng.choice(rng.integers(0, 1 << 24, n), (h, w)) if n else rng.integers(0, 1 << 24, (h, w))
    x = x.astype(np.uint32) | (rng.integers(0, 256, (h, w)).astype(np.uint32) << 24 if rng.integers(2) else np.uint32(0xFF000000))
    shape = ((h + (1 << tile) - 1) >> tile, (w + (1 << tile) - 1) >> tile)
    how = {"palette": bool(len(np.unique(x)) <= 256 and rng.integers(2)), "green": bool(rng.integers(2)), "cache_bits": int(rng.choice([0, 0, 1, 5, 11])), "lz": bool(rng.integers(2)), "tile": tile}
    if not how["palette"]:
        how["predictor"] = rng.integers(0, 14, shape)
        how["cross"] = rng.integers(0, 1 << 24, shape).astype(np.uint32) | np.uint32(0xFF000000) if rng.integers(2) else None
    if rng.integers(2):
        across = w if not how["palette"] else (w + (1 << webp_decode._bundle(len(np.unique(x)))) - 1) >> webp_decode._bundle(len(np.unique(x)))
        how |= {"meta": rng.integers(0, int(rng.choice([2, 5, 12])), ((h + 3) >> 2, (across + 3) >> 2)), "meta_tile": 2}
    assert np.array_equal(webp.decode(webp.encode(x, **how)), x)


def by_hand(*fields):
    """A file from (value, bits) fields as the format describes them, lowest bit first; no encoder takes part."""
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in fields if n)
    bits += "0" * (-len(bits) % 8)
    body = b"\x2f" + bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def one(symbol):
    """A simple code of one symbol below 256."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a, b):
    """A simple code of two symbols: the smaller one is bit 0."""
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def size(w, h):
    return [(w - 1, 14), (h - 1, 14), (0, 1), (0, 3)]


#: A normal code in which symbol 1 of 280 (or so) and symbol 257 have one bit each: lengths 0, 1, 0 x 255, 1.
#: Code length symbols in use: 0, 1 and 18; in the order 17 18 0 1 their sizes are 0 2 2 1.
PIXEL_OR_COPY = [(0, 1), (0, 4), (0, 3), (2, 3), (2, 3), (1, 3), (1, 1), (1, 3), (3, 4)]
#: 3 = most - 2: five code length symbols. Codes by size: 1 -> 0, 0 -> 10, 18 -> 11 (first bit first).
PIXEL_OR_COPY += [(1, 2), (0, 1), (3, 2), (127, 7), (3, 2), (117 - 11, 7), (0, 1)]


def test_webp_by_hand():
    argb = lambda a, r, g, b: a << 24 | r << 16 | g << 8 | b
    plain = by_hand(*size(3, 2), (0, 1), (0, 1), (0, 1), *one(7), *one(200), *one(9), *one(255), *one(0))
    assert webp.decode(plain).tolist() == [[argb(255, 200, 7, 9)] * 3] * 2
    green = by_hand(*size(2, 1), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *two(5, 6), *one(250), *one(1), *one(255), *one(0), (0, 1), (1, 1))
    assert webp.decode(green).tolist() == [[argb(255, 255, 5, 6), argb(255, 0, 6, 7)]]
    # palette of two colours, eight pixels a byte: 1 0 1; the table holds differences
    table = [(0, 1), *two(10, 20), *one(0), *one(0), *two(0, 255), *one(0), (0, 1), (1, 1), (1, 1), (0, 1)]
    palette = by_hand(*size(3, 1), (1, 1), (3, 2), (1, 8), *table, (0, 1), (0, 1), (0, 1), *one(5), *one(0), *one(0), *one(255), *one(0))
    assert webp.decode(palette).tolist() == [[argb(255, 0, 30, 0), argb(255, 0, 10, 0), argb(255, 0, 30, 0)]]
    # predictor mode 2 (above) in one tile; differences 1 everywhere, the first pixel from black
    tiles = [(0, 1), *one(2), *one(0), *one(0), *one(255), *one(0)]
    predictor = by_hand(*size(2, 2), (1, 1), (0, 2), (0, 3), *tiles, (0, 1), (0, 1), (0, 1), *one(1), *one(0), *one(0), *one(0), *one(0))
    assert webp.decode(predictor).tolist() == [[argb(255, 0, 1, 0), argb(255, 0, 2, 0)], [argb(255, 0, 2, 0), argb(255, 0, 3, 0)]]
    # cross-colour: green 16 with multiplier 64 adds (16 * 64) >> 5 = 32 to red, and -64 takes 32 from blue
    cross = [(0, 1), *one(192), *one(0), *one(64), *one(255), *one(0)]
    crossed = by_hand(*size(1, 1), (1, 1), (1, 2), (0, 3), *cross, (0, 1), (0, 1), (0, 1), *one(16), *one(1), *one(2), *one(255), *one(0))
    assert webp.decode(crossed).tolist() == [[argb(255, 33, 16, (2 - 32) & 255)]]
    # one pixel, then a copy of length 2 (symbol 257) at distance code 2, which is one to the left
    code = PIXEL_OR_COPY
    copied = by_hand(*size(3, 1), (0, 1), (0, 1), (0, 1), *code, *one(4), *one(3), *one(255), *one(1), (0, 1), (1, 1))
    assert webp.decode(copied).tolist() == [[argb(255, 4, 1, 3)] * 3]


def test_webp_payloads():
    rng = np.random.default_rng(0)
    for n in (0, 5, 192, 193, 70000, 64 * 3 * 16384 + 5):
        p = webp.padded(rng.integers(32, 127, n).astype(np.uint8).tobytes())
        assert len(p) % 192 == 0 and webp.load(webp.store(p)).tobytes() == p
    texts = [(" ".join(rng.choice(["the", "of", "line", "\n", "words", "1234"], n)) + "é" * (n % 7)).encode() for n in (3, 40, 700, 3000)]
    for form in webp.FORMS:
        stored = [webp.store(webp.padded(t), form) for t in texts]
        array = webp._pixels(pa.array([stored[0], None], pa.binary()))
        assert array[2].to_pylist() == [webp.padded(texts[0]), None] and array[1].to_pylist() == [64, None]
        assert [x.tobytes() for x in webp.load_many(stored)] == [webp.padded(t) for t in texts]
        assert all(len(webp.smallest(webp.padded(t))) <= len(m) for t, m in zip(texts[:2], stored, strict=False))
    good = webp.store(webp.padded(b"hello world, hello"))
    for k in range(0, len(good), 3):
        with pytest.raises(ValueError):
            webp.load(good[:k] if k > 8 else b"RIFX" + good[4:])


def test_salvage():
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 50) for i in range(6)]
    parts = [warc.member(warc.page_record(i, u, p, None, False)) for i, u, p in pages]
    data = b"".join(parts)
    assert [r[0] for r in warc.salvage(data)] == ["record"] * 6
    bad = bytearray(data)
    at = len(parts[0]) + len(parts[1]) + len(parts[2]) // 2
    bad[at] ^= 0xFF
    found = list(warc.salvage(bytes(bad)))
    assert [r[4].get("warc-record-id") for r in found if r[0] == "record"] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    gaps = [r for r in found if r[0] == "gap"]
    assert len(gaps) == 1 and gaps[0][1] == len(parts[0]) + len(parts[1]) and gaps[0][2] == gaps[0][1] + len(parts[2])
    plain = b"".join(warc.page_record(i, u, p, None, False) for i, u, p in pages[:3])
    broken = plain.replace(b"<p>1</p>", b"<p>9</p>", 1)
    assert [r[0] for r in warc.salvage(b"junk" + broken + b"tail")] == ["gap", "record", "gap", "record", "gap"]
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_a_member():
    pages = [(i, f"http://x/{i}", (f"<p>{i}</p>" + "".join(random.Random(i).choices("abcdef ", k=9000))).encode()) for i in range(3)]
    recs = [warc.page_record(i, u, p, None, False) for i, u, p in pages]
    ids = lambda found: [r[4]["warc-record-id"][10:-1] for r in found if r[0] == "record"]
    wrong = recs[1].replace(b"<p>1</p>", b"<p>9</p>", 1)
    other = warc.member(warc.page_record(7, "u", b"x", None, False))
    data = warc.member(recs[0] + wrong + recs[2]) + other  # the CRC holds, one digest doesn't
    found = list(warc.salvage(data))
    assert ids(found) == ["0", "2", "7"] and [r[1:3] for r in found if r[0] == "gap"] == [(0, len(data) - len(other))]
    whole = warc.member(b"".join(recs))
    cut = whole[: len(whole) * 3 // 4] + other  # a cut member: the records before the cut are whole
    found = list(warc.salvage(cut))
    assert ids(found) == ["0", "1", "7"] and sum(r[0] == "gap" for r in found) == 1
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0xFF
    assert {"0", "7"} <= set(ids(list(warc.salvage(bytes(flipped) + other))))


def test_salvage_is_linear_and_takes_long_heads():
    url = "data:," + "x" * 300_000
    one = warc.member(warc.page_record(1, url, b"<p>", None, False))
    found = list(warc.salvage(one + b"\0" * 1000 + one))
    assert [r[0] for r in found] == ["record", "gap", "record"] and found[0][4]["warc-target-uri"] == url
    import time

    def took(n):
        small = [warc.member(warc.page_record(i, "u", random.Random(i).randbytes(900), None, False)) for i in range(n)]
        bad = [m[:-1] + b"\0" if k % 3 == 0 else m for k, m in enumerate(small)]
        began = time.process_time()
        assert sum(r[0] == "record" for r in warc.salvage(b"".join(bad))) >= n * 2 // 3 - 1
        return time.process_time() - began

    took(100)
    assert took(4000) < 20 * took(500) + 0.5


def test_webp_writes_references_wherever_pixels_repeat(monkeypatch):

    from cliplane.llm import webp_encode

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:400]
    seen = []
    real = webp_decode.Table.copied

    def counted(self, at):
        found = real(self, at)
        seen.append(len(found[1]))
        return found

    monkeypatch.setattr(webp_decode.Table, "copied", counted)
    some = carried = 0
    for t in texts:
        payload = webp.padded(t.encode())
        form = webp._CHOICE[zlib.crc32(payload) % len(webp._CHOICE)]
        if form not in ("references", "cache", "groups"):
            continue
        stored = webp.store(payload)
        repeats = any(len(webp_encode.copies_of(x.ravel())[0]) for x in webp._images(payload))
        seen.clear()
        assert webp.load(stored).tobytes() == payload
        some, carried = some + repeats, carried + (repeats and sum(seen) > 0)
    assert some > 200 and carried == some


def test_webp_digests_are_those_of_the_padded_text():
    rng = np.random.default_rng(9)
    texts = ["", None, "a", "é" * 96, "x" * 192, "word " * 4000, "".join(map(chr, rng.integers(32, 0x2FF, 5000)))]
    got = [c.to_pylist() for c in webp._columns(pa.array(texts, pa.string()))]
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = webp.store(payload)
        want = [len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()]
        assert [c[k] for c in got[:6]] == want
        rgb = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        assert got[6][k] == f"64x{len(rgb)}:" + ":".join(str(int(rgb[..., c].sum(dtype=np.int64)) * 1000 // (64 * len(rgb))) for c in range(3))


def test_toxicity_features_again_word_by_word():
    texts = ["You stupid IDIOT!! go away", "a clean text, nothing else", "", "st*pid m0ron you", "THE END of it..."]
    x = toxicity.Lexicon().features(pa.array(texts, pa.string()))
    column = {n: k for k, n in enumerate(toxicity.NAMES)}
    for row, t in zip(x, texts, strict=True):
        words = re.findall("[A-Za-z]+", t)
        low, n = [w.lower() for w in words], max(1, len(words))
        want = {
            "strong": 100 * sum(w in toxicity.STRONG for w in low) / n, "mild": 100 * sum(w in toxicity.MILD for w in low) / n, "second": 100 * sum(w in toxicity.SECOND for w in low) / n,
            "capitals": sum(c.isupper() for c in t) / max(1, len(t)), "capital_words": sum(w.isupper() and len(w) > 1 for w in words) / n,
            "punctuation": sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in t) / max(1, len(t)), "exclaims": t.count("!") / max(1, len(t)), "length": np.log1p(len(t)),
        }
        for name, value in want.items():
            assert abs(row[column[name]] - value) < 1e-9, (t, name)
    assert x[3][column["obfuscated"]] > 0 and x[1][column["obfuscated"]] == 0 and x[0][column["aimed"]] > 0 and x[1][column["aimed"]] == 0


def test_webp_code_lengths_in_runs_are_those_read_one_by_one(monkeypatch):
    from cliplane.llm import webp_decode, webp_encode

    rng = np.random.default_rng(12)
    real, longest = webp_decode._run, []

    def noted(code, bits):
        found = real(code, bits)
        longest.append(found[0])
        return found

    monkeypatch.setattr(webp_decode, "_run", noted)
    webp_decode.inner_code.cache_clear()
    for n in (3, 40, 200, 280):
        lengths = webp_encode.code_lengths(np.where(rng.random(280) < n / 280, rng.integers(1, 50, 280), 0))
        w = webp_encode.Writer()
        values, sizes = webp_encode.code_header(lengths)
        w.many(np.array(values, np.int64), np.array(sizes, np.int64))
        found = webp_decode.read_code(webp_decode.Reader(w.bytes()), 280)
        want = webp_decode.Code(lengths)
        assert found.width == want.width and (found.symbol == want.symbol).all() and (found.size == want.size).all()
    assert max(longest) >= 3


def test_webp_side_by_side_is_image_by_image(monkeypatch):
    """Many images of every kind are read together, only the longest by themselves, and give what each gives alone."""
    alone = webp_decode.Coded.pixels
    files, want = [], []
    for seed in range(300):
        rng = np.random.default_rng(seed)
        h, w = int(rng.integers(1, 30)), int(rng.integers(1, 30))
        x = rng.choice(rng.integers(0, 1 << 24, int(rng.choice([1, 3, 20, 300]))), (h, w)).astype(np.uint32)
        x |= rng.integers(0, 256, (h, w)).astype(np.uint32) << 24 if rng.integers(2) else np.uint32(0xFF000000)
        how = {"green": bool(rng.integers(2)), "cache_bits": int(rng.choice([0, 0, 1, 5, 11])), "lz": bool(rng.integers(3))}
        if rng.integers(2):
            how |= {"meta": rng.integers(0, int(rng.choice([2, 5])), ((h + 3) >> 2, (w + 3) >> 2)), "meta_tile": 2}
        files.append(webp.encode(x, **how))
        want.append(x)
    several = []
    monkeypatch.setattr(webp_decode.Coded, "pixels", lambda self: several.append(self.height * self.width) or alone(self))
    coded = [webp_decode.Parsed(f).coded for f in files]
    several.clear()
    got = webp_decode.read_all(coded)
    assert len(several) == webp_decode.LANES
    assert all(np.array_equal(a, alone(c)) for a, c in zip(got, coded, strict=True))
    assert all(np.array_equal(a, x) for a, x in zip(webp.decode_many(files), want, strict=True))
    monkeypatch.setattr(webp_decode, "ENTRIES", 1 << 17)  # in several rounds
    assert all(np.array_equal(a, x) for a, x in zip(webp.decode_many(files), want, strict=True))


def test_webp_damaged_among_many():
    rng = np.random.default_rng(3)
    words = [" ".join(rng.choice(["the", "of", "line", "\n", "words", "1234", "Ab"], 200)).encode() for _ in range(200)]
    for form in webp.FORMS:
        stored = [webp.store(webp.padded(t), form) for t in words]
        assert [x.tobytes() for x in webp.load_many(stored)] == [webp.padded(t) for t in words]
        body = stored[150][20:-12]
        cut = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
        with pytest.raises(ValueError, match="the stream ends early"):
            webp.load_many([*stored[:150], cut, *stored[151:]])


def test_webp_every_form_has_its_share():
    """No form is left to a few images: each is written for about an eighth of the different texts or more."""
    texts = dict.fromkeys(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist())
    chosen = [webp._CHOICE[zlib.crc32(webp.padded((t or "").encode())) % len(webp._CHOICE)] for t in texts]
    assert all(chosen.count(form) > len(chosen) / 10 for form in webp.FORMS)


def test_webp_written_together_is_one_by_one(monkeypatch):
    """Images of every kind are written together, their codes made at once, and give the files that each gives alone."""
    from cliplane.llm import webp_encode

    told, want = [], []
    for seed in range(200):
        rng = np.random.default_rng(seed)
        h, w, n = int(rng.integers(1, 30)), int(rng.integers(1, 30)), int(rng.choice([1, 2, 30, 0]))
        x = rng.choice(rng.integers(0, 1 << 32, n), (h, w)) if n else rng.integers(0, 1 << 32, (h, w))
        how = {"lz": bool(seed & 1), "cache_bits": int(rng.choice([0, 1, 6, 11])), "palette": seed % 5 == 0 and len(np.unique(x)) <= 256}
        if seed % 3 == 0 and not how["palette"]:
            how |= {"meta": rng.integers(0, 5, ((h + 3) >> 2, (w + 3) >> 2)), "meta_tile": 2}
        if seed % 4 == 1:
            how |= {"predictor": rng.integers(0, 14, ((h + 3) >> 2, (w + 3) >> 2)), "green": True} if not how["palette"] else {}
        told.append((x, how))
        want.append(webp.encode(x, **how))
    assert all(np.array_equal(a, x) for a, (x, _) in zip(webp.decode_many(want), told, strict=True))
    real, lots = webp_encode.many_lengths, []
    monkeypatch.setattr(webp_encode, "many_lengths", lambda *a: lots.append(1) or real(*a))
    assert list(webp_encode.encode_many(webp_encode.planes(x, **how) for x, how in told)) == want and len(lots) == 1
    monkeypatch.setattr(webp_encode, "ROOM", 10000)
    assert list(webp_encode.encode_many(webp_encode.planes(x, **how) for x, how in told)) == want and 2 < len(lots) < 40
    payloads = [webp.padded(b"one two three %d " % k * (k % 90)) for k in range(300)]
    assert webp.store_many(payloads) == [webp.store(p) for p in payloads]


def test_webp_lengths_of_many_codes_are_those_of_plain_trees():
    import heapq

    from cliplane.llm import webp_encode

    rng = np.random.default_rng(8)
    every = [rng.integers(1, 1 << int(rng.integers(1, 20)), int(rng.choice([0, 1, 2, 3, 40, 256, 700]))) for _ in range(150)]
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    every += [np.array(fibonacci), np.array(fibonacci[:12]), np.array([1] * 5)]
    many = np.array([len(w) for w in every])
    got = np.split(webp_encode.many_lengths(np.concatenate(every), many), np.cumsum(many)[:-1])
    for w, length in zip(every, got, strict=True):
        alone = np.array(webp_encode.code_lengths(w))
        assert np.array_equal(alone, length) and (len(w) < 2 or (0.5**length).sum() == 1) and length.max(initial=0) <= 15
        heap, cost = w.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        free = (webp_encode.many_lengths(w, np.array([len(w)]), 60) * w).sum() if len(w) > 1 else 0
        assert free == cost and (len(w) < 2 or (length * w).sum() >= cost)


def test_webp_code_with_over_a_thousand_lengths():
    rng = np.random.default_rng(1)
    for colours in (1500, 2500):
        x = rng.choice(rng.integers(0, 1 << 24, colours), (300, 200))
        assert np.array_equal(webp.decode(webp.encode(x, cache_bits=11)), x)
