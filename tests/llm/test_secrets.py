"""Secret scan: base patterns against the contract's regular expressions, novelty on known strings."""

from __future__ import annotations

import hashlib
import random
import re

from tidebook.llm import secrets as S

DOCS = "doc_id long, text string"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    """Kind, start and end by the plain patterns, failing matches dropped."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(S.KINDS[k], a, b) for a, k, b in sorted(found)]


def check_query(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        named = [f"{k}:{a}:{b}" for k, a, b in want]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("novel")] == named
        taken = [tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith("novel")]
        assert all(not (a < e and s < b) for s, e in taken for _, a, b in want)


def test_query_on_whole_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = S.op2_secrets(spark, small).collect()
    assert len(rows) == docs.count()
    check_query(rows, texts)


def test_base_patterns_on_made_up_texts(spark):
    rng = random.Random(3)
    pieces = ["password", "API_KEY", "ſecret", "token", '"', "'", " ", ":", "=", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef01", "0123456789abcdef", "é", "\n", "x/y+z==", "日"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, ""]
    got = S.annotate(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    for r in got:
        spans = [(S.KINDS[s.kind], s.start, s.end) for s in r.secrets.spans if s.kind < 3]
        assert spans == base_spans(texts[r.doc_id])


def test_novelty_tells_keys_from_words():
    s = S.Scanner()
    key = "q7Zx9KpL2mVb8RtY4wNc"
    assert [(a, b) for a, b, _ in s.novel(f"Authorization: Bearer {key} end", b"authorization: bearer", [])] == [(22, 42)]
    assert s.novel("the access path is src/module_1/module_1/module_1 here", b"access", []) == []
    assert s.novel("a token of version1.version1.version1 again", b"token", []) == []
    repeated = f"{key} {key} access {key}"
    assert all(n < 1 for _, _, n in s.novel(repeated, b"access", []))


def test_novel_spans_never_touch_base_spans(spark):
    text = "secret = q7Zx9KpL2mVb8RtY4wNc and bearer Hh3Kk9Qq2Ww8Ee5Rr1Tt"
    spans = S.annotate(spark.createDataFrame([(1, text)], DOCS)).first().secrets.spans
    assert [(S.KINDS[s.kind], text[s.start : s.end]) for s in spans] == [("assign", "secret = q7Zx9KpL2mVb8RtY4wNc"), ("novel", "Hh3Kk9Qq2Ww8Ee5Rr1Tt")]


def test_long_texts_clashes_and_empty_tables(spark):
    long = "f" * 500_000 + " token " * 50_000 + "AKIA" + "Q" * 20
    df = spark.createDataFrame([(1, long, 2, "y"), (1, long, 2, "y")], "doc_id long, text string, c1 int, r string")
    rows = S.annotate(df).collect()
    assert [(r.c1, r.r, [s.kind for s in r.secrets.spans]) for r in rows] == [(2, "y", [2, 1])] * 2
    assert S.annotate(spark.createDataFrame([], DOCS)).count() == 0


def test_telling_words_inside_names():
    s, key = S.Scanner(), "q7Zx9KpL2mVb8RtY4wNcT5hJ"
    names = ["SECRET_KEY = '{}'", "client_secret_id: {}", "db_password_prod={}", "secretKey = {}", "apiKeyProd: {}", "tokens: {}", "encryption_key = {}"]
    for text in (n.format(key) for n in names):
        assert [text[a:b] for a, b, _ in s.novel(text, text.lower().encode(), [])] == [key], text


def test_keys_of_any_alphabet_are_new():
    s, rng = S.Scanner(), random.Random(5)
    for letters in ("0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"):
        for size in (64, 128):
            texts = ["Authorization: Bearer " + "".join(rng.choices(letters, k=size)) for _ in range(40)]
            assert sum(bool(s.novel(t, t.lower().encode(), [])) for t in texts) >= 36, (letters, size)
    assert s.novel("token " + "-" * 64, b"token", []) == []


def test_keys_in_names_of_any_form():
    s, rng = S.Scanner(), random.Random(8)
    key = lambda: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=20))
    for line in ('SECRET_KEY = "{}"', 'DB_PASSWORD_PROD := "{}"', "token_value <- {}", "private_key_data {}"):
        texts = [(k, line.format(k)) for k in (key() for _ in range(40))]
        found = [[t[a:b] for a, b, _ in s.novel(t, t.lower().encode(), [])] == [k] for k, t in texts]
        assert sum(found) >= 38, line
    for name in ("getUserNameById2Value", "application/json/default_value", "your_password_here_12", "content-type-header-value"):
        assert s.novel(f"bearer {name}", b"bearer", []) == [], name


WORDS = "harbour lantern meadow copper violet winter orchard pebble thunder canvas marble falcon timber velvet anchor bridge candle desert ember forest garden hollow island jungle kettle ladder mirror needle ocean pillow".split()


def test_precision_and_recall_on_planted_keys_and_identifiers(spark, tmp_path):
    """Words of the corpus make identifiers that the fixed words do not know; keys of five alphabets stand beside them."""
    rng = random.Random(12)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"] * 3 + ["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789"]
    texts, secret = [], []
    for i in range(600):
        prose = " ".join(rng.choices(WORDS, k=60))
        if i % 2:
            own = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 44)))
            secret.append({own})
        else:
            words = rng.choices(WORDS, k=rng.randint(3, 5))
            own = rng.choice(("_".join(words), "".join(w.title() for w in words), "-".join(words)))
            secret.append(set())
        texts.append(f"{prose}\nAuthorization: Bearer {own}\n{prose}")
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = S.op2_secrets(spark, str(tmp_path)).collect()
    check_query(rows, dict(enumerate(texts)))
    right = found = 0
    for r in rows:
        got = [s.split(":") for s in r.spans.split(",") if s.startswith("novel")]
        got = {texts[r.doc_id][int(a) : int(b)] for _, a, b in got}
        right, found = right + len(got & secret[r.doc_id]), found + len(got)
    assert right >= 0.98 * found and right >= 0.95 * sum(map(len, secret))


def test_a_copied_secret_does_not_become_a_known_word(spark):
    key = "qzvkxwjqpzmt"
    docs = spark.createDataFrame([(i, f"the secret part {key} of it") for i in range(3000)] + [(i, f"plain words number {i} here") for i in range(200)], DOCS)
    known = S.vocabulary(docs)
    assert key not in known.words + known.left_out and "plain" in known.words + known.left_out
    assert S.NOVELTY_BOUNDS[0] <= known.novelty <= S.NOVELTY_BOUNDS[1]
    assert S.vocabulary(spark.createDataFrame([], DOCS)).words == ()
