import base64
import bz2
import gzip
import hashlib
import lzma
import random
import time
import zlib
from urllib.parse import quote

from conftest import prose
from test_texts import plain_spans

from accessloom.llm import secrets

SECRET = "password = hunter2hunter2"


def test_long_compressed_urlsafe_payloads():
    r = random.Random(31)
    packers = (zlib.compress, lambda d: gzip.compress(d)[:9] + b"\x03" + gzip.compress(d)[10:], bz2.compress, lzma.compress)
    split = 0
    for i in range(200):
        data = packers[i % 4](f"{prose(r, 20)} {SECRET} {prose(r, 3)}".encode())
        for encode in (base64.urlsafe_b64encode, base64.b64encode):
            code = encode(data).decode().rstrip("=" * (i % 3 // 2))
            split += "_" in code or "-" in code
            text = f"so {code} end"
            assert (3, 3 + len(code), "assign") in secrets.scan(text)[1], text
    assert split > 150


def test_parts_in_one_alphabet():
    code = base64.b64encode(f"{SECRET}!".encode()).decode().rstrip("=")
    for text, at in ((f"/path/{code}", 6), (f"name-{code}", 5), (f"a_b/{code}", 4), (f"{code}_tail", 0), (f"{code}/x-{code}", 0)):
        spans = [s for s in secrets.scan(text)[1] if s[2] == "assign"]
        assert spans, text


def percent(r, text):
    return "".join(c if c.isalnum() and r.random() < 0.5 else "".join(f"%{b:02{r.choice('xX')}}" for b in c.encode()) for c in text)


def escaped(r, text):
    units = [int.from_bytes(u, "big") for c in text for e in [c.encode("utf-16-be")] for u in [e[i : i + 2] for i in range(0, len(e), 2)]]
    return "".join(chr(u) if u < 128 and chr(u).isalnum() and r.random() < 0.5 else f"\\u{u:04x}" if u > 255 or r.random() < 0.8 else f"\\x{u:02x}" for u in units)


def coded(r, text):
    return r.choice((base64.b64encode, base64.urlsafe_b64encode))(text.encode()).decode().rstrip(r.choice(("", "=")))


def packed(r, text):
    return base64.b64encode(r.choice((zlib.compress, gzip.compress, bz2.compress, lzma.compress))(text.encode())).decode()


def wrapped(r, text):
    code, n = base64.b64encode(text.encode()).decode(), r.choice((16, 20, 64, 76))
    return r.choice(("\n", "\r\n", "\n  ")).join(code[i : i + n] for i in range(0, len(code), n))


def test_every_nest_is_found_with_its_span():
    """All coders in random nests; only escapes outside: the very span of the secret. Base64 within: the span it takes in the text."""
    r = random.Random(77)
    kinds = {"assign": lambda: f"{r.choice(('token', 'API_KEY', 'Secret'))}{r.choice(('=', ': ', chr(39) + ' = '))}{hashlib.md5(str(r.random()).encode()).hexdigest()[:20]}z", "access": lambda: "AKIA" + "".join(r.choices("ABCDEFGH0123", k=16)), "hex": lambda: hashlib.sha256(str(r.random()).encode()).hexdigest()}
    for _ in range(600):
        kind = r.choice(list(kinds))
        secret = kinds[kind]()
        inner = f"{r.choice(('', 'é, ', 'see '))}{secret}{r.choice((', \U0001f600', '', ' and'))}"
        code, plain = inner, True
        for coder in r.choices((percent, escaped, coded, packed, wrapped), k=r.randint(1, 4)):
            plain &= coder in (percent, escaped)
            code = coder(r, code)
        text = f"{prose(r, 4)}. ü, {code}, {prose(r, 3)}"
        at = text.index(code)
        base, spans = secrets.scan(text)
        assert base == plain_spans(text)
        found = [s for s in spans if s[2] == kind and at <= s[0] < s[1] <= at + len(code)]
        assert found, (kind, text)
        if plain:
            inside = [s for s in found if s not in base]
            whole = max(found, key=lambda s: s[1] - s[0])
            assert settled(text[whole[0] : whole[1]]).strip("\"' ") == secret or not inside, (whole, text)


def settled(text):
    """Escapes taken off until none is left."""
    while True:
        new = secrets._peeled(secrets.Layer(text, None, None), 0, len(text)).text
        if new == text:
            return text
        text = new


def test_fixpoint_is_that_of_repeated_peeling():
    r = random.Random(5)
    parts = ["%", "25", "41", "%25", "%2", "5", "\\u00", "\\u0025", "\\x", "4", "%c3%a9", "%ff", "\\ud83d", "\\ude00", "a", "\\U0001f600", "%5cu0041", "\\"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        layer = secrets._settled(secrets.Layer(text, None, None), 0, len(text))
        if "�" not in layer.text and "�" not in settled(text):
            assert layer.text == settled(text), text
        assert len(layer.starts) == len(layer.ends) == len(layer.text) and list(layer.starts) == sorted(layer.starts)


def test_layers_that_are_not_clean_text():
    code = lambda data: base64.b64encode(data).decode()
    wanted = SECRET.encode()
    for body in (
        code(b"\x00\xff " + wanted + b"\x07\xfe"),
        code(b"\x1b[1m" + wanted + "\xa0​".encode()),
        code(gzip.compress(b"first") + gzip.compress(wanted)),
        code(bz2.compress(b"first") + bz2.compress(wanted)),
        code(lzma.compress(b"first") + b"\0" * 4 + lzma.compress(wanted)),
        code(zlib.compress(wanted + b" " + random.Random(1).randbytes(4000))[:-600]),
        code(gzip.compress(gzip.compress(bz2.compress(wanted)))),
        code(b"x^ " + wanted),
        quote(SECRET, safe="") + "%ff%zz",
        "%ff" + quote(SECRET, safe=""),
        "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET),
    ):
        spans = secrets.scan(f"é, {body}")[1]
        assert [s for s in spans if s[2] == "assign" and 3 <= s[0] < s[1] <= 3 + len(body)], body


def test_large_layers_are_scanned_in_blocks():
    r = random.Random(3)
    filler = "".join(f"word{i} " for i in range(40_000))
    for at in (0, len(filler) // 2, len(filler)):
        code = base64.b64encode(gzip.compress(f"{filler[:at]}, {SECRET}, {filler[at:]} {r.random()}".encode())).decode()
        assert (0, len(code.rstrip('='))) in {s[:2] for s in secrets.scan(code, 4096, 512)[1]} or (0, len(code)) in {s[:2] for s in secrets.scan(code, 4096, 512)[1]}


def test_deep_nests_take_linear_time():
    for text in ("%" + "25" * 40_000 + "41", "token=%" + "25" * 40_000 + "41bcdefgh", "\\u005cu005c" * 8000, "%41" * 27_000):
        began = time.perf_counter()
        spans = secrets.scan(text)[1]
        assert time.perf_counter() - began < 2
        assert ("token" in text) == any(s[2] == "assign" for s in spans)
