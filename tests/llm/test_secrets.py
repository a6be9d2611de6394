import hashlib
import math
import random
import re

from tidewater.llm import secrets
from tidewater.llm.secrets import redact, secret_digest

SCHEMA = "doc_id long, text string, secrets string, body string, base long"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN.replace("(?i:", "(?ai:"), text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def entropy(text):
    found = set()
    masked = text
    for word in secrets.ALLOW_WORDS:
        masked = masked.replace(word, " " * len(word))
    inside = [(m.start(), m.end()) for p in secrets.ALLOW_INSIDE for m in re.finditer(p, text)]
    for _, run, w, least in secrets.CLASSES:
        for m in re.finditer(run, masked):
            if any(re.search(p, m[0]) for p in secrets.ALLOW) or any(re.search(p, text[: m.start()]) for p, _ in secrets.ALLOW_BEFORE):
                continue
            if any(a <= m.start() <= b for a, b in inside):
                continue
            spans = []
            for i in range(len(m[0]) - w + 1):
                part = m[0][i : i + w]
                h = -sum(part.count(c) / w * math.log2(part.count(c) / w) for c in set(part))
                if h >= least:
                    a, b = m.start() + i, m.start() + i + w
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
            found |= {(a, 3, b) for a, b in spans}
    held = base(text)
    found = {x for x in found if not any(y[0] <= x[0] and x[2] <= y[2] for y in held)}
    return {x for x in found if not any(y != x and y[0] <= x[0] and x[2] <= y[2] for y in found)}


def want(text):
    name = lambda x: f"{secrets.KINDS[x[1]]}:{x[0]}:{x[2]}"
    text = text or ""
    held = base(text)
    return (*[sum(x[1] == k for x in held) for k in range(3)], hashlib.sha256(",".join(map(name, held)).encode()).hexdigest(), ",".join(map(name, sorted({*held, *entropy(text)}))))


def texts():
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    made = [
        None, "", "password=token:abcdefgh", "API_KEY: 'abc'", "apikey=\"abcdef\"tail", "Paſſword=abcdefg toKen=abcdefg", "AKIA" + "Z9" * 8, "AKIAAKIA" + "X" * 11,
        "é\U0001F600 " + "0123456789abcdef" * 3, "deadbeef" * 3, "sha256:" + hashlib.sha256(b"x").hexdigest().upper(), hashlib.sha256(b"y").hexdigest().upper(),
        "id 123e4567-e89b-12d3-a456-426614174000 end", "https://x.example/" + "".join(rng.choices(b64, k=40)), "x" * 60_000, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        "https://x.example/" + "a/" * 2500 + "".join(rng.choices(b64, k=40)).replace("+", "Q"), "https://x.org/?sig=" + "".join(rng.choices(b64, k=40)), "sk_example_" + "".join(rng.choices(b64, k=40)),
        " ".join("".join(rng.choices("0123456789abcdef", k=30)) for _ in range(700)), " ".join("".join(rng.choices(b64, k=40)) for _ in range(300)),
        "secret = " + "".join(rng.choices(b64, k=40)) + " and " + "".join(rng.choices(b64, k=500)), "".join(rng.choices(b64, k=2000)),
    ]
    bits = ["password", "Token", "secret=", ":", "=", " ", "\n", "'", "AKIA", "ABCD1234", "0123abcd", "é", "api_key", "wordly-words", "/", "\U0001F600"]
    for _ in range(150):
        made.append("".join(rng.choice([*bits, "".join(rng.choices(b64, k=rng.randint(1, 50)))]) for _ in range(rng.randint(1, 25))))
    return made


def test_spans_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3]), (None, "token=abcdef")]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, secret_digest(df).collect()), key=str)
    assert got == sorted(((d, *want(t)) for d, t in rows), key=str)
    assert secret_digest(df.limit(0)).collect() == []
    assert any("entropy" in r[-1] for r in got)


def test_megabytes_of_joints(spark):
    """Joined words of any length neither overflow a stack nor count as secrets, and what follows them is still found."""
    rows = [(i, ("ab" + joint) * 350_000 + "ab token=abcdefgh", "", "", 1) for i, joint in enumerate("-_/")]
    rows.append((3, "a-" * 500_000 + "-a", "", "", 1))
    got = {r.doc_id: r for r in secret_digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].spans for i in range(4)] == ["assign:1050003:1050017"] * 3 + [""]


def test_redaction_leaves_the_rest(spark):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(texts())]
    for before, after in zip(rows, sorted(redact(spark.createDataFrame(rows, SCHEMA)).collect()), strict=True):
        text, out, at = before[1], "", 0
        for a, _, b in sorted({*base(text or ""), *entropy(text or "")}):
            out += "" if a < at else (text[at:a] + "[SECRET]")
            at = max(at, b)
        assert tuple(after) == (before[0], text if text is None else out + text[at:], *before[2:])
