import random
import time
import re

from pyspark.sql import functions as F

from loomdoc.llm import secrets


def test_secrets_base_and_random(spark):
    rng = random.Random(9)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [None, "", "pass\U0001f600word: x", 'Token = "' + draw(b64, 30) + '" é', "AKIA" + draw("ABCDEFGH0123", 16), "token=secret: abcdefgh1", "x" * 50, " password:abcdefgh", "0123456789abcdef" * 3, "API_KEY:'short'"]
    texts += ["plain words only and nothing else " * 3] * 30 + [f"see {draw(b64, 44)} here" for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["found"]] for r in secrets.scan(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [s for s in found[i] if s[1] < 3] == sorted(want), t
    assert sum(any(s[1] == 3 for s in found[i]) for i in range(len(texts) - 6, len(texts))) >= 4
    assert not any(s[1] == 3 for i in [*range(3), 6, *range(10, 40)] for s in found[i])


def test_secrets_after_names_and_decimals(spark):
    rng = random.Random(19)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    forms = ["AWS_SECRET_ACCESS_KEY={}", "export DB_KEY={} end", "see https://h.example/a_b/c?x_y=1&sig={}&z=2", "a_long_name_of_a_setting={}==", "in /srv/some_where/{} here"]
    cases = [(f, draw(b64.rstrip("+/") if "/srv" in f else b64, 43)) for f in forms for _ in range(5)]
    cases += [("pin {} end", draw("0123456789", 30)) for _ in range(8)]
    plain = ["n %s end" % t for t in ("0" * 24, "1234567890" * 3, "1000000000000000000000", "7" * 29)]
    texts = [f.format(x) for f, x in cases] + plain
    found = {r["doc_id"]: [t for t in r["found"] if t["kind"] == 3] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hit = lambda i: [texts[i][s["start"] : s["end"]] for s in found[i]]
    for k, form in enumerate([*forms, "decimal"]):
        own = range(25, 33) if form == "decimal" else range(5 * k, 5 * k + 5)
        assert sum(any(cases[i][1] in h and "_" not in h and len(h) < 55 for h in hit(i)) for i in own) >= len(own) * 3 // 5, (form, [hit(i) for i in own])
    assert [hit(len(cases) + i) for i in range(len(plain))] == [[]] * len(plain)


def test_precision_and_recall_on_planted_tokens(spark):
    """Tokens of 32 characters are mostly found and those of 120 always; of a thousand ordinary names, paths and words next to none is."""
    rng = random.Random(29)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = {"base64": low + up + digits + "+/", "base64url": low + up + digits + "-_", "base62": low + up + digits, "mixed": low + up, "single": low + digits, "upper": up + digits, "base32": up + "234567", "hex": digits + "ABCDEF"}
    words = "the quick configuration manager returns account number identifier status value handler service request response builder default template document library application system user group index cache string buffer length current previous update delete insert select from where order".split()
    name = {
        "snake": lambda: "_".join(rng.choice(words) for _ in range(rng.randrange(4, 9))),
        "camel": lambda: "".join(rng.choice(words).capitalize() for _ in range(rng.randrange(3, 7))),
        "path": lambda: "/".join(rng.choice(words) for _ in range(rng.randrange(4, 9))),
        "slug": lambda: "-".join([*(rng.choice(words) for _ in range(4)), str(rng.randrange(2030))]),
        "glued": lambda: "".join(rng.choice(words) for _ in range(rng.randrange(4, 7))),
        "fill": lambda: rng.choice("0aX") * rng.randrange(20, 60),
        "count": lambda: "".join(map(str, [first + k for first in [rng.randrange(100, 900)] for k in range(12)])),
    }
    rows, kind = [], []
    for k, make in name.items():
        for _ in range(150):
            rows.append(f"see {make()} here")
            kind.append(k)
    for form, chars in alphabets.items():
        for n in (32, 48, 120):
            for _ in range(12):
                rows.append(f"see {draw(chars, n)} here")
                kind.append((form, n))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("found", F.lit("x"))
    found = {r["doc_id"]: sum(s["kind"] == 3 for s in r["found"]) for r in secrets.scan(docs).collect()}
    hits = {k: sum(found[i] > 0 for i, x in enumerate(kind) if x == k) / kind.count(k) for k in dict.fromkeys(kind)}
    wrong = sum(found[i] > 0 for i, x in enumerate(kind) if isinstance(x, str))
    right = sum(found[i] > 0 for i, x in enumerate(kind) if not isinstance(x, str))
    print(hits)
    assert wrong <= secrets.FDR * right, hits
    assert all(v >= {32: 0.5, 48: 0.7, 120: 1.0}[k[1]] for k, v in hits.items() if not isinstance(k, str)), hits
    assert right >= 0.85 * sum(not isinstance(x, str) for x in kind), hits


def test_base_spans_stay_and_get_a_verdict(spark):
    rng = random.Random(7)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["token=" + "".join(rng.choice(b64) for _ in range(40)) for _ in range(20)] + ["token=my_password_is_my_password_again"] * 5
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(len(r["found"]) == 1 and r["found"][0]["kind"] == 0 for r in got)
    assert sum(r["found"][0]["random"] for r in got if r["doc_id"] < 20) >= 18 and not any(r["found"][0]["random"] for r in got if r["doc_id"] >= 20)


def test_very_long_and_repeated_texts(spark):
    many = "token=abcdefgh1 " * 30_000
    got = {r["doc_id"]: r["found"] for r in secrets.scan(spark.createDataFrame([(1, many), (2, "token=abcdefgh1"), (2, "token=abcdefgh1")], "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[1]] == [(16 * k, 16 * k + 15) for k in range(30_000)] and len(got[2]) == 1


def test_many_spans_are_swept(spark, monkeypatch):
    rng = random.Random(13)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
    token = lambda n: "".join(rng.choice(b64) for _ in range(n))
    texts = [" ".join(rng.choice([f"token={token(12)}", token(40), f"secret: {token(30)}/x", token(20) + "=" * 2, "word"]) for _ in range(60)) for _ in range(12)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one_by_one = sorted(tuple(r) for r in secrets.scan(docs).collect())
    monkeypatch.setattr(secrets, "PAIRS", 0)
    assert sorted(tuple(r) for r in secrets.scan(docs).collect()) == one_by_one


def test_many_base_spans_and_runs_in_one_text(spark):
    rng = random.Random(14)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pool = ["".join(rng.choice(b64) for _ in range(40)) for _ in range(500)]
    text = " ".join(f"token=abcdefgh{k % 10} {pool[k % 500]}" for k in range(8_000))
    began = time.monotonic()
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["found"]
    assert sum(s["kind"] == 0 for s in got) == 8_000 and sum(s["kind"] == 3 for s in got) > 6_000
    assert time.monotonic() - began < 120
