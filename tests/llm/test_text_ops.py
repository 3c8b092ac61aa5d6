"""Chat formatting, secret scans and personal data against plain Python."""

import hashlib
import re

import pytest

from strandlake.llm import chat, personal, secrets

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b \\l < > é\U0001f600 </turn>\n"), (1, 0, "user", "<next>"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "a>\\<", "")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(chats(spark, rows))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "<next>"), ("assistant", rows[0][3]), ("assistant", ""), ("assistant", "")]
    assert out[1].loss_text == rows[0][3] and out[1].formatted.count("<turn:") == 2
    assert [tuple(t) for t in out[2].turns] == [("", "x")] and [tuple(t) for t in out[None].turns] == [("a>\\<", "")]
    assert chat.format_chats(chats(spark, [])).count() == 0


DOCS = "doc_id long, text string, blob string, spans int"
SECRETS = ["token = \"abcdef12\" AKIA" + "A" * 16 + " x", None, "", "PASSWORD:'short' api-key=1 apikey=zzzzzz\n" + "0123456789abcdef" * 3 + "G", "é\U0001f600secret=aaaaaa" * 3, "ſecret=abcdefg", "a" * 200_000, "token = \"abcdef12\" AKIA" + "A" * 16 + " x"]


def plain_base(text):
    text, out = text or "", []
    for i, (kind, pattern, ok) in enumerate((
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return ",".join(x[2] for x in sorted(out))


def test_secrets_match_plain(spark):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(SECRETS)] + [(None, "secret=abcdefg", "c", 1), (0, SECRETS[0], "c", 1)], DOCS)
    paths, entries = secrets.scan_ledger(docs)
    rows = secrets.digest(paths).collect()
    assert len(rows) == len(SECRETS) + 2
    for r in rows:
        text = "secret=abcdefg" if r.doc_id is None else SECRETS[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(plain_base(text).encode()).hexdigest()
    assert entries.count() == len({t or "" for t in SECRETS} | {"secret=abcdefg"})
    more = docs.union(spark.createDataFrame([(90, "token: 1234567890", "c", 1)], DOCS))
    paths, new = secrets.scan_ledger(more, entries)
    assert new.count() == 1 and paths.count() == len(SECRETS) + 3
    assert secrets.scan_ledger(more, entries, version="next")[1].count() == entries.count() + 1
    assert secrets.digest(secrets.scan_ledger(docs.limit(0))[0]).count() == 0


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_personal(text):
    text, out, digits = text or "", [], lambda s: re.sub("[^0-9]", "", s)
    for i, (kind, pattern, ok) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
    )):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return ",".join(x[2] for x in sorted(out))


PERSONAL = [
    "x@y.zz_q@r.s a.b@c-d.e@f.g @h.i j@k", "1.2.3.4.5.6.7.8 256.1.1.1 0001.000.255.9 é1.1.1.1", "4111 1111-1111 1111 and 4111111111111112 -5555555555554444 5 - 5105105105105100",
    "+1 (017) 555-7713 +1..9 tel +49-30-12345678 99", None, "", "é\U0001f600a@b.c " * 3, "GB82 WEST 1234 5698 7654 32 GB82WEST12345698765433", "1" * 50_000, "a" * 50_000, "1 " * 30_000, "+" + "1" * 30_000, "1.1.1." * 9000, "a@b.c." * 2000,
]


def test_personal_matches_plain(spark):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(PERSONAL)] + [(None, "a@b.cd", "x", 2)], DOCS.replace("blob", "path"))
    found = {r.path: r for r in personal.find_personal(docs).collect()}
    for i, text in enumerate(PERSONAL):
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found[i].spans if s.kind in personal.BASE) == plain_personal(text), i
    assert [(s.start, s.end) for s in found[7].spans] == [(0, 27)]
    assert found[3].spans[-1].score == pytest.approx(0.7) and len(found[None].spans) == 1
