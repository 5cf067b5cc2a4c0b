"""Recall and false hits of the character models on labelled samples, and the time of a text full of spans."""

import random
import string
import time
import uuid

from shardwright.llm import secrets_scan

WORDS = ("user list map model order table report index cache value header parser stream window config driver session "
         "network release monitor account garden river mountain letter number winter summer engine market history").split()


def ordinary(rnd):
    word = lambda: rnd.choice(WORDS)
    return {
        "slug": lambda: f"{rnd.randrange(1990, 2030)}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 29):02}-{word()}-{word()}-{word()}",
        "part": lambda: f"{word()}-{rnd.randrange(100, 9999)}-rev{rnd.randrange(1, 30)}-{word()}",
        "version": lambda: f"{word()}-{word()}-v{rnd.randrange(1, 20)}-{rnd.randrange(0, 50)}-{rnd.randrange(0, 90)}",
        "path": lambda: "/" + "/".join(word() for _ in range(4)),
        "snake": lambda: "_".join(word() for _ in range(3)),
        "camel": lambda: word() + "".join(word().title() for _ in range(3)),
        "uuid": lambda: str(uuid.UUID(int=rnd.getrandbits(128))),
    }


def secret(rnd):
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    return {
        "mixed": lambda: draw(string.ascii_letters + string.digits, 32),
        "base64": lambda: draw(string.ascii_letters + string.digits + "+/", 40),
        "upper": lambda: draw(string.ascii_uppercase + string.digits, 28),
        "lower": lambda: draw(string.ascii_lowercase + string.digits, 32),
    }


def test_recall_and_false_hits_by_style(spark):
    rnd = random.Random(3)
    rows, styles = [], {}
    for made, per_style in ((ordinary(rnd), 400), (secret(rnd), 60)):
        for style, make in made.items():
            for _ in range(per_style):
                token = make()
                styles[len(rows)] = style
                rows.append((len(rows), f"see {token} there"))
    for k in range(100):  # labelled by the base patterns
        rows.append((10_000 + k, f"token = {secret(rnd)['mixed']()}"))
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, kind int")
    hits = {}
    for r in secrets_scan.find_secrets(frame).collect():
        if r["doc_id"] in styles:
            hits.setdefault(styles[r["doc_id"]], []).append(r["n_markov"] > 0)
    rates = {k: sum(v) / len(v) for k, v in hits.items()}
    print(rates)
    for style in secret(rnd):
        assert rates[style] >= 0.9, rates
    for style in ordinary(rnd):
        assert rates[style] < 0.02, rates


def test_a_text_of_50_000_tokens_and_one_long_token(spark):
    rnd = random.Random(4)
    parts = [f"{rnd.getrandbits(64):016x} someordinary_identifier" for _ in range(50_000)]
    text = " ".join(parts) + " " + "xy" * 100_000
    frame = spark.createDataFrame([(1, text), (2, None), (2, "")], "doc_id long, text string")
    secrets_scan.find_secrets(frame.filter("doc_id = 2")).collect()
    start = time.time()
    got = {r["doc_id"]: r for r in secrets_scan.find_secrets(frame).collect()}
    took = time.time() - start
    print(took)
    assert got[1]["n_hex"] == 50_000 and got[2]["spans"] == ""
    at, want = 0, []
    for p in parts:
        want.append(f"hex:{at}:{at + 16}")
        at += len(p) + 1
    assert [s for s in got[1]["spans"].split(",") if s.startswith("hex")] == want
    assert took < 60
