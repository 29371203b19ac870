import pytest

from corpusloom.functions.sizes import parse_size, size_bytes, token_estimate
from corpusloom.functions.specs import is_remote, source_spec

GOOD = {
    "1024": 1024, "1K": 1024, "1k": 1024, "1M": 1 << 20, "1m": 1 << 20, "1G": 1 << 30,
    "1g": 1 << 30, "4M": 4 << 20, " 7 ": 7, "+5K": 5120,
}
BAD = ["invalid", "", "4MB", "1 K", "-1", "1.5M", "K"]


def test_size_literals(spark):
    rows = [(x,) for x in [*GOOD, *BAD, "99999999999999999999"]]
    got = spark.createDataFrame(rows, "s string").select("s", parse_size("s").alias("n"))
    found = {r.s: r.n for r in got.collect()}
    assert found == {**GOOD, **dict.fromkeys(BAD), "99999999999999999999": None}


def test_size_literals_strict(spark):
    df = spark.createDataFrame([("4MB",)], "s string")
    with pytest.raises(Exception, match="Invalid size format: 4MB"):
        df.select(parse_size("s", strict=True)).collect()


@pytest.mark.parametrize("literal", [k for k in GOOD])
def test_size_option(literal):
    assert size_bytes(literal) == GOOD[literal]


@pytest.mark.parametrize("literal", BAD)
def test_bad_size_option(literal):
    with pytest.raises(ValueError):
        size_bytes(literal)


def test_token_estimate_rounds_up(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 40, 41, 1 << 40)], "n bigint")
    got = [r[0] for r in df.select(token_estimate("n")).collect()]
    assert got == [-(-n * 13 // 40) for n in (0, 1, 3, 4, 40, 41, 1 << 40)]


def cases():
    """Specs by the grammar: address x reference x subpath, web addresses and shell-style ones.

    Yields (spec, url, subpath, reference, remote).
    """
    web = {"https://forge.test/ann/loom.git": True, "HTTP://forge.test/x": True, "./near/loom": False, "far/loom.git": True,
           "ssh://forge.test:22/a.git": True, "/srv/x.GIT": False}
    references = [None, "main", "v2.0-rc1", "feature/a_b", "0a1b2c3d", ""]
    subpaths = [None, "docs", "src/a/b", ""]
    for address, remote in web.items():
        for ref in references:
            for sub in subpaths:
                spec = address + ("" if ref is None else f"@{ref}") + ("" if sub is None else f"#{sub}")
                yield spec, address, sub, ref, remote
    for address in ("git@forge.test:ann/loom.git", "GIT@forge.test:loom"):
        for ref in (None, "main", "b-1"):
            for sub in (None, "docs", "src/a/b"):
                spec = address + ("" if ref is None else f"@{ref}") + ("" if sub is None else f":{sub}")
                yield spec, address, sub, ref, True
    # The last mark of a kind parts; marks before it belong to the address.
    yield "https://me:pw@forge.test/x.git@dev#lib", "https://me:pw@forge.test/x.git", "lib", "dev", True
    yield "https://me@forge.test/x", "https://me", None, "forge.test/x", True
    yield "p#q#r@s", "p#q", "r@s", None, False
    yield "git@https://u:v", "git", None, "https://u:v", False


def test_source_specs(spark):
    expected = {spec: tuple(rest) for spec, *rest in cases()}
    df = spark.createDataFrame([(s,) for s in expected], "spec string")
    parsed = df.select("spec", source_spec("spec").alias("s"))
    got = parsed.select("spec", "s.*", is_remote("s.url").alias("remote")).collect()
    assert {r.spec: (r.url, r.subpath, r.reference, r.remote) for r in got} == expected
