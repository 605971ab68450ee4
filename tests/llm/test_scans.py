"""Secrets, licenses and personal data."""

import base64
import hashlib
import json
import random
import re
import time

import regex

from tallyloom.llm.licenses import NOTICES, automaton, fuzzy, licenses
from tallyloom.llm.personal import personal_data
from tallyloom.llm.secrets import redacted, secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


KEY = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([7]) * 40) for _ in range(4)))
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub":1}', b"s" * 20))


def test_secrets_base_and_structure(docs, by_id):
    good, bad = base64.b64encode(KEY).decode(), base64.b64encode(b"\x30\x82\x01" + b"z" * 120).decode()
    ssh = base64.b64encode(b"\0\0\0\x07ssh-rsa" + b"\0\0\0\x03abc" + b"\0\0\0\x20" + b"k" * 32).decode()
    rows = [
        (1, f"é😀 API_key = 'abcdEFGH1' and token:short password=token:abcdefgh {'a' * 31} {'0f' * 16}"),
        (2, f"x {TOKEN} y eyJhbGci.abc.def"), (3, f"k {good} {bad}"), (4, f"{ssh} AKIA{'A' * 12} AKIA{'B' * 11}"),
        (5, f"-----BEGIN PRIVATE KEY-----\n{good}\n-----END PRIVATE KEY-----"), (6, KEY.hex()), (7, None), (8, ""), (9, "clean " * 30_000),
    ]
    got = by_id(secrets(docs(rows + rows[:1])))
    assert len(got[1]) == 2
    r = got[1][0]
    t = rows[0][1]
    a, h = t.index("API_key"), t.index("0f0f")
    want = f"assign:{a}:{t.index(chr(39), a + 12)},hex:{h}:{h + 32}"
    assert (r["n_assign"], r["n_hex"], r["spans"]) == (1, 1, want) and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    kinds = lambda i: [s.split(":")[0] for s in got[i][0]["spans"].split(",") if s]
    assert kinds(2) == ["jwt"] and kinds(3) == ["der"] and kinds(4) == ["ssh", "access"]
    assert "pem" in kinds(5) and "der" in kinds(6) and "hex" in kinds(6)
    assert kinds(7) == kinds(8) == kinds(9) == []
    assert secrets(docs([])).count() == 0
    clean = by_id(redacted(docs(rows)))
    assert "abcdEFGH1" not in clean[1][0]["text"] and clean[7][0]["text"] is None and clean[9][0]["text"] == rows[8][1]
    assert good not in clean[5][0]["text"] and clean[2][0]["text"].startswith("x [secret] y")


def field(b):
    return len(b).to_bytes(4, "big") + b


def test_private_ssh_keys_are_parsed_to_the_end(docs, by_id):
    public = field(b"ssh-ed25519") + field(b"p" * 32)
    head = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big")
    whole = [head + field(public) + field(b"s" * 64), head + field(public) + field(b"s" * 64) + b"x", head + field(b"junk") + field(b"s" * 64), b"openssh-key-v1\0" + b"z" * 80]
    got = by_id(secrets(docs([(i, base64.b64encode(b).decode()) for i, b in enumerate(whole)])))
    assert ["ssh" in got[i][0]["spans"] for i in range(4)] == [True, False, False, False]


def test_hostile_headers_are_no_tokens(docs, by_id):
    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 200_000).decode().rstrip("=")
    wide = base64.urlsafe_b64encode(b'{"alg":1' + b"0" * 5_000 + b"}").decode().rstrip("=")
    got = by_id(secrets(docs([(1, f"{deep}.abc.def"), (2, f"{wide}.abc.def"), (3, f"x {TOKEN}")])))
    assert "jwt" not in got[1][0]["spans"] + got[2][0]["spans"] and "jwt" in got[3][0]["spans"]


def longhand_base(text):
    """The contract's base spans, sign by sign and with its patterns as they stand."""
    found = []
    for name, pattern, fits in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        compiled, at = re.compile(pattern, re.I | re.A if name == "assign" else 0), 0
        while m := compiled.search(text, at):
            found += [(m.start(), name, m.end())] if fits(m) else []
            at = m.end()
    order = ["assign", "access", "hex"]
    return ",".join(f"{k}:{i}:{j}" for i, k, j in sorted(found, key=lambda s: (s[0], order.index(s[1]))))


def test_secrets_base_is_longhand(docs, by_id):
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdefgh", "AKIA", "Q7" * 8, "0a" * 16, "ſecret", "é", "😀", "/", "-", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    for i, r in by_id(secrets(docs(rows))).items():
        want = longhand_base(rows[i][1])
        assert r[0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r[0]["spans"].split(","))


def test_licenses(docs, by_id):
    rows = [
        (1, "Under the MIT License! under the mit-license; CC BY-NC"), (2, "relesed undr the mit license"), (3, "Licensed under the Apache Licence, Version 2.0"),
        (4, "GNU General Publick License"), (5, "the mit of license"), (6, None), (7, ""), (8, "word " * 30_000 + "cc by nc"),
    ]
    got = {k: v[0] for k, v in by_id(licenses(docs(rows))).items()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 8, "cc-by-nc,mit") and got[1]["score"] == 1.0
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "mit" and 0.9 < got[2]["score"] < 1 and got[2]["first_word"] is None
    assert got[3]["labels"] == "apache-2" and got[4]["labels"] == "gpl" and got[5]["labels"] == "" and got[5]["score"] == 0
    assert got[6]["n_words"] == got[7]["n_words"] == 0 and got[8]["first_word"] == 30_000
    span = got[2]["spans"].split(":")
    assert (int(span[1]), int(span[2])) == (0, len(rows[1][1]))
    assert licenses(docs([])).count() == 0


def brute_personal(t):
    t, o = t or "", []
    o += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            o.append(("card", m))
    o += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in o)


def test_personal_data(docs, by_id):
    seeds = [(100 + i, f"my passport number is p{i}@x{i}.com thanks") for i in range(9)]
    rows = [
        (1, None), (2, ""), (3, "a@b.c_d@e.f 1.2.3.4.5 999.1.1.1 001.002.003.004 é😀 x@y.zz"), (4, "4111 1111 1111 1111, +1 (017) 555-7713- 4111-1111-1111-1112 +12 3"),
        (5, "1" * 20_000 + "." + "2." * 9_000), (6, "a" * 50_000 + "@"), (7, "x.y@" + "a." * 8_000 + "com"), (8, "my passport number is X1234567, thanks"), (9, "nothing 12345 here"),
    ] + seeds
    got = by_id(personal_data(docs(rows + rows[2:3])))
    assert len(got[3]) == 2
    for i, t in rows:
        want = brute_personal(t)
        assert got[i][0]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), i
        assert got[i][0]["spans"].startswith(want)
    assert got[8][0]["spans"] == "context:22:30" and got[9][0]["spans"] == ""
    assert personal_data(docs([])).count() == 0


def test_accepted_strings_induce_patterns(docs, by_id):
    """Recall of planted identifiers: by a seed's context, by contexts of what that found, and so on."""
    rows = [(i, f"please write to u{i}@mail{i}.com today") for i in range(12)]
    first = [f"AB-{i}77" for i in range(6)]
    second = [f"q{i}_zz" for i in range(8)]
    rows += [(100 + i, f"please write to {s} today") for i, s in enumerate(first[:3])]
    rows += [(110 + i, f"my badge reads {s} since {9000 + i}") for i, s in enumerate(first[:3])]
    rows += [(120 + i, f"my badge reads {s} since spring") for i, s in enumerate(second[:2])]
    rows += [(130 + i, f"word{i} other{i} 5{i}55{i} more{i} end") for i in range(30)]
    got = by_id(personal_data(docs(rows)))
    found = {i: "context" in r[0]["spans"] for i, r in got.items()}
    assert all(found[100 + i] and found[110 + i] for i in range(3))  # by the seeds' context
    assert all(found[120 + i] for i in range(2))  # by the context that the accepted ones induced
    assert not any(found[i] for i in [*range(12), *range(130, 160)])
    long = "x9" * 300
    got = by_id(personal_data(docs([*rows[:12], (200, f"please write to {long} today"), (201, f"aside {long} again")])))
    assert got[200][0]["spans"] == "context:16:616" and got[201][0]["spans"] == "context:6:606"


def test_a_chain_of_contexts_is_followed_to_its_end(docs, by_id):
    """Each context holds the strings of the two before it, three of its own and one seed, too few alone."""
    steps, name = 13, "abcdefghijklmnop"
    rows = [(i, f"please write to u{i}@mail{i}.com today") for i in range(12)]
    strings = [[f"x{n}_{k}" for k in range(6 if n == 0 else 3)] for n in range(steps)]
    for n in range(steps):
        said = f"step leads{name[n]} on{name[n]} {{}} always{name[n]}" if n else "please write to {} today"
        held = [*(strings[n - 1] if n else []), *(strings[n - 2] if n > 1 else []), *strings[n], *([f"v{n}@web{n}.org"] if n else [])]
        rows += [(1000 + 100 * n + k, said.format(s)) for k, s in enumerate(held)]
    got = by_id(personal_data(docs(rows)))
    missed = [i for i, t in rows if i >= 1000 and "@" not in t and "context" not in got[i][0]["spans"]]
    assert missed == []


def test_every_copy_of_a_notice_is_reported(docs, by_id):
    rows = [(1, "mozila public license, mozilla public license"), (2, "mozila public license, mozilla public license, mozilla publik license")]
    got = {k: v[0] for k, v in by_id(licenses(docs(rows))).items()}
    assert got[1]["labels"] == "mpl" and got[1]["score"] == 1.0
    assert len(got[1]["spans"].split(",")) == 2 and len(got[2]["spans"].split(",")) == 3


def plain_notices(low):
    """All copies of every notice by one search over the whole text, the best first, then on either side of it."""
    found = set()
    for notice, label in NOTICES.items():
        edits = len(notice) // 10
        pattern, stretches = regex.compile(f"(?:{regex.escape(notice)}){{e<={edits}}}", regex.BESTMATCH), [(0, len(low))]
        while stretches:
            i, j = stretches.pop()
            m = pattern.search(low, i, j) if j - i >= len(notice) - edits else None
            if m:
                found.add(f"{label}:{m.start()}:{m.end()}")
                stretches += [(i, m.start()), (m.end(), j)]
    return found


def test_notices_equal_a_plain_search(docs, by_id):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            notice = list(rng.choice(list(NOTICES)))
            for _ in range(rng.randrange(0, len(notice) // 10 + 2)):
                at = rng.randrange(1, len(notice) - 1)
                notice[at : at + rng.randrange(2)] = rng.choice(["q", "", "z"])
            text += ["".join(notice), " ".join(rng.choice(["sea", "old", "ships", "license", "public"]) for _ in range(rng.randrange(8, 20)))]
        rows.append((i, ". ".join(text).upper() if i % 2 else ". ".join(text)))
    got = by_id(licenses(docs(rows)))
    for i, t in rows:
        assert set(filter(None, got[i][0]["spans"].split(","))) == plain_notices(t.lower()), t


def test_a_long_text_of_near_notices_takes_time_in_proportion(docs, by_id):
    took = []
    for n in (3_000, 24_000):
        text, began = "releazed under the mit license " * n, time.time()
        found = fuzzy(text, automaton(), {k: regex.compile(f"(?:{regex.escape(k)}){{e<={len(k) // 10}}}", regex.BESTMATCH) for k in NOTICES})
        took.append(time.time() - began)
        assert len(found) == n
    assert took[1] < 30 * took[0]
