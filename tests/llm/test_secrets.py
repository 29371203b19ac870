import hashlib
import random
import re
import zlib

from corpusloom.llm import secrets

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def signed(prefix, body):
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = secrets.DIGITS.decode()[d] + digits
    return prefix + body + digits


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def texts():
    pick = random.Random(3)
    bits = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "é", "ſecret", "K"]
    bits += ["abc", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRST", "akia", "deadbeef" * 3, "\n", "日本", "x" * 7]
    return ["".join(pick.choices(bits, k=pick.randint(0, 40))) for _ in range(400)]


def test_against_plain_patterns(docs_of, awkward):
    rows = [(i, t) for i, t in enumerate(texts(), 100)] + [r[:2] for r in awkward]
    got = secrets.secret_digests(docs_of(rows)).collect()
    want = sorted(
        (str(i), hashlib.sha256(",".join(base(t or "")).encode()).hexdigest(), ",".join(base(t or ""))) for i, t in rows
    )
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["spans"]) for r in got) == want
    assert all(r["n_assign"] + r["n_access"] + r["n_hex"] == len([*filter(None, r["spans"].split(","))]) for r in got)


def test_checksums_decide(docs_of):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, npm = signed("ghp_", body), signed("npm_", body)
    wrong = good[:-1] + ("0" if good[-1] != "0" else "1")
    rows = [(1, f"ü {good}!"), (2, wrong), (3, good + "x"), (4, f"{npm} and {good}")]
    got = {r["doc_id"]: r for r in secrets.secret_digests(docs_of(rows)).collect()}
    assert got[1]["spans"] == "github:2:42" and got[1]["n_checked"] == 1
    assert got[2]["spans"] == got[3]["spans"] == ""
    assert got[4]["spans"] == "npm:0:40,github:45:85"
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(docs_of):
    assert secrets.secret_digests(docs_of([])).count() == 0
