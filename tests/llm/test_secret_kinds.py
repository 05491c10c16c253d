"""Candidates of the secret scan: each kind of secret is one, whole and alone, and harmless values go."""

import random

from rankframe.llm import secretscan

HARMLESS = ["author: Jonathan wrote this", "password: required", "token = ${DB_TOKEN}", "the secret: nobody knows", "see http://www.site.org/2019/the-long-winter-of-1984/ now",
            "usr/lib/python/site/packages/v3/main", "an internationalization effort"]


def kinds(n):
    r = random.Random(77)
    alnum = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    key = lambda k, of=alnum: "".join(r.choices(of, k=k))
    for _ in range(n):
        word = r.choice(["Winter", "Dragon", "Monkey", "Summer", "Orange"]) + str(r.randint(1960, 2029))
        yield "password", f'password = "{word}" in the file', word
        mixed = key(6) + "!" + key(3) + "@" + key(4)
        yield "symbols", f"db_password: {mixed}.", mixed
        low = key(32, "abcdefghijklmnopqrstuvwxyz")
        yield "letters", f'token = "{low}"', low
        short = key(12, "0123456789abcdef")
        yield "short key", f"api_key='{short}', then", short
        inside = key(11)
        yield "user info", f"at postgres://admin:{inside}@db.host.org/x", inside
        part = key(32)
        yield "path part", f"call https://hooks.host.com/v2/{part} at once", part
        last = key(40)
        yield "end of sentence", f"The access key is token={last}.", last


def test_each_kind_is_found_whole_and_harmless_values_go(spark):
    rows = list(kinds(30))
    texts = [t for _, t, _ in rows] + HARMLESS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in secretscan.scan(docs, secretscan.train(spark)).collect():
        got.setdefault(x.doc_id, []).append((x.nth, x.candidate, x.secret))
    for i, (kind, text, secret) in enumerate(rows):
        assert secret in [c for _, c, _ in got.get(i, [])], (kind, text)
    share = {}
    for i, (kind, _, secret) in enumerate(rows):
        share.setdefault(kind, []).append((secret, True) in [(c, s) for _, c, s in got[i]])
    share = {k: sum(v) / len(v) for k, v in share.items()}
    print(share)
    assert min(share.values()) >= 0.9, share
    assert all(sorted(n for n, _, _ in v) == list(range(len(v))) for v in got.values())
    wrong = [c for i in range(len(rows), len(texts)) for _, c, s in got.get(i, []) if s]
    assert wrong == []
