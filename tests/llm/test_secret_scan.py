import hashlib
import re
import zlib

import numpy as np
from conftest import SF_CHECK
from flowrisk.llm import secret_scan as S
from flowrisk.llm.queries import all_queries

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plainly(text):
    """Base spans by regular expressions over the whole text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def base(text):
    raw = text.encode()
    return [s for s in S.in_code_points(raw, S.spans(raw)) if S.KINDS[s[1]].base]


def base62(n):
    out = ""
    for _ in range(6):
        out, n = S.BASE62[n % 62] + out, n // 62
    return out


def forged(prefix, secret="aB3" * 10):
    return prefix + secret + base62(zlib.crc32(secret.encode()))


def base58(raw):
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        out, n = S.BASE58[n % 58] + out, n // 58
    return out


def bech(prefix, data):
    """The checksum by the definition of the code, written apart from the scanner's."""
    def polymod(values):
        c = 1
        for v in values:
            b = c >> 25
            c = (c & 0x1FFFFFF) << 5 ^ v
            for i in range(5):
                c ^= S.BECH32_GENERATOR[i] if b >> i & 1 else 0
        return c
    head = [ord(x) >> 5 for x in prefix] + [0] + [ord(x) & 31 for x in prefix]
    p = polymod(head + data + [0] * 6) ^ 1
    return prefix + "1" + "".join(S.BECH32[v] for v in data + [p >> 5 * (5 - i) & 31 for i in range(6)])


def test_random_texts_equal_whole_regexes():
    rng = np.random.default_rng(3)
    words = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "APIKey", "secretoken", "AKIA", "akia", "AKIA" + "X" * 16, "=", ": ", " ", "  ", '"', "'", "abcdef", "0123456789", "deadbeef" * 3, "ABCDEF", "é", "日", "İ", "K", "ſecret", "\n", "x", "value1", "a" * 23, "f" * 24, "to", "ken=", "==", "-._/"]
    for case in range(1500):
        text = "".join(rng.choice(words, int(rng.integers(0, 25))))
        assert base(text) == plainly(text), (case, text)


def test_edges():
    assert base("token = abc12 token=abcdef") == [(14, 0, 26)]
    assert base("secret=secret=longer1") == plainly("secret=secret=longer1") == [(0, 0, 21)]
    assert base("password: 'é") == []
    assert base("AKIA" + "A" * 15) == [] and base("AKIA" + "A" * 16) == [(0, 1, 20)]
    assert base("ABC" + "0" * 24 + "G") == [(3, 2, 27)]
    assert base("é" * 3 + "token=abcdef" + "日" + "0" * 24) == [(3, 0, 15), (16, 2, 40)]
    assert base("token=" + "0" * 24) == [(0, 0, 30), (6, 2, 30)]
    assert base("password" + " " * 200_000 + "x") == []
    assert base("0" * 300_000) == [(0, 2, 300_000)]


def test_checksums():
    kinds = lambda t: [S.KINDS[i].name for _, i, _ in S.spans(t.encode()) if not S.KINDS[i].base]
    for good, kind in ((forged("ghp_"), "forge"), (forged("ghs_", "Z" * 30), "forge"), (forged("npm_"), "package"), (bech("nsec", [i % 32 for i in range(52)]), "bech32"), (bech("age-secret-key-", [3] * 52).upper(), "bech32")):
        assert kinds(f"see {good}, here") == [kind], good
        i = good.index("_") + 3 if "_" in good else 20
        broken = good[:i] + ("Q" if good[i] != "Q" else "7") + good[i + 1 :]
        assert kinds(broken) == []
        assert kinds(good + "x") == []
    body = bytes.fromhex("0488ade4") + bytes(range(74))
    key = base58(body + hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4])
    assert len(key) == 111 and key.startswith("xprv")
    assert kinds(key) == ["xprv"] and kinds(key[:-1] + ("2" if key[-1] != "2" else "3")) == []
    # published vectors of the two formats
    assert kinds("xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi") == ["xprv"]
    assert kinds("nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5") == ["bech32"]


def test_added_spans_leave_base_spans(spark):
    token = forged("ghp_", "deadbeef0123456789deadbeef0123")
    text = f"é token={token} end"
    d = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, None, "x"), (3, "", "x"), (4, ("clean text " * 100_000) + text, "x")], "doc_id int, text string, spans string")
    got = {}
    for r in S.scan(d).collect():
        got.setdefault(r["doc_id"], []).append([tuple(s) for s in r["spans"]])
    want = [(S.KINDS[i].name, s, e) for s, i, e in plainly(text)] + [("forge", 8, 48)]
    want.sort(key=lambda s: (s[1], [k.name for k in S.KINDS].index(s[0])))
    assert got[1] == [want, want] and got[None] == [want] and got[2] == [[]] and got[3] == [[]]
    assert got[4] == [[(k, s + 1_100_000, e + 1_100_000) for k, s, e in want]]
    assert S.scan(d.limit(0)).count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    got = all_queries()["op12_secret_scan"](spark, SF_CHECK).collect()
    assert len(got) == len(texts) and sum(r["n_hex"] for r in got) > 0
    for r in got:
        found = plainly(texts[r["doc_id"]])
        joined = ",".join(f"{S.BASE_KINDS[i]}:{s}:{e}" for s, i, e in found)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(i == k for _, i, _ in found) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in S.BASE_KINDS] == [x for x in joined.split(",") if x]
