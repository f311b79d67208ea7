import base64
import hashlib
import random
import re

from rarefold.llm import secrets as S


def naive(text):
    spans = []
    for kind, pat, ok in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pat, text) if ok(m)]
    return sorted(spans, key=lambda s: (s[1], S.KINDS.index(s[0])))


def base(text):
    return [s for s in S.scan(text) if s[0] in ("assign", "access", "hex")]


def test_base_against_plain_search():
    rng = random.Random(5)
    bits = ["password", "PassWD", "secret=", "toKen", "toKen=abcdefgh1", "api_key", "APIKEY", ": ", " = ", '"', "'", "abcdefgh12", "AKIA", "AKIAAKIA", "ABCDEFGHIJKL", "deadbeef", "0" * 31, "f" * 33, " ", "\n", "é", "İ", "ſecret=abcdefghij", "x", "secretoken:aaaaaaaa"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert base(text) == naive(text), text


def test_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + S.crc_tail(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert S.scan(f"x {good} y")[-1] == ("crctoken", 2, 42) and not S.scan(f"x {bad} y")
    raw = b"\x80" + bytes(range(32))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, wif = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        wif = S._BASE58[r] + wif
    assert [s[0] for s in S.scan(f"key {wif}.")] == ["wif"]
    assert not S.scan(f"key {wif[:-1]}{'2' if wif[-1] != '2' else '3'}.")
    part = lambda s: base64.urlsafe_b64encode(s).decode().rstrip("=")
    jwt = f"{part(b'{\"alg\":\"HS256\"}')}.{part(b'{\"sub\":1}')}.abc"
    assert S.scan(jwt) == [("jwt", 0, len(jwt))] and not S.scan(jwt.replace("eyJ", "eyK", 1))


def test_documents(awkward, empty):
    got = {(r.doc_id, r.spans) for r in S.digest(S.scan_documents(awkward)).collect()}
    assert got == {(r.doc_id, S.listed(S.scan(r.text or ""))) for r in awkward.collect()}
    assert S.digest(S.scan_documents(empty)).count() == 0
    assert S.digest(S.scan_documents(awkward)).count() == awkward.count()


def test_redaction(spark, awkward):
    df = spark.createDataFrame([(1, "say password=abcdefgh1 now", 3, "k"), (2, None, 7, "k"), (3, "clean", 99, "k")], "doc_id long, text string, n_chars int, __k string")
    rows = {r.doc_id: r for r in S.redact_documents(df).collect()}
    assert rows[1].text == "say [secret] now" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[2].n_chars == 7 and rows[3].n_chars == 99
    assert S.redact_documents(awkward).columns == awkward.columns
    assert all(not S.scan(r.text or "") for r in S.redact_documents(awkward).collect())


def test_nested_and_dotless_tokens():
    import base64
    import time

    from rarefold.llm.secrets import scan

    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    good = part(b'{"alg":"x"}')
    deep = part(b'{"a":' + b"[" * 500_000 + b"]" * 500_000 + b"}")
    t = time.time()
    assert deep.startswith("eyJ") and not [x for x in scan(f"{deep}.{good}.abc") if x[0] == "jwt"]
    assert not [x for x in scan("eyJ" * 400_000) if x[0] == "jwt"]
    assert not [x for x in scan("eyJ" * 200_000 + "." + "eyJ" * 200_000) if x[0] == "jwt"]
    assert not [x for x in scan("a" * 1_000_000 + "0" * 20) if x[0] == "jwt"]
    assert time.time() - t < 20
    late = "eyJ" * 50 + f" {good}.{good}.sig"
    assert [x for x in scan(late) if x[0] == "jwt"] == [("jwt", 151, len(late))]
    inner = f"xx{good}.{good}.s {good}.{good}.t"
    assert len([x for x in scan(inner) if x[0] == "jwt"]) == 2
