"""Text expressions agree with Python's string semantics on random mixed-Unicode input."""

import random
import re

from rankframe.functions import text as TX

ALPHABET = (list("abcXYZ019_-,.;:'\"/!?()[]") + [" ", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85",
                                                  "\xa0", " ", "　"]
            + list("éÉüßçñøÅΣσςΑλ²½٣ｶ") + ["́", "İ", "K", "ǅ"])


def rand_text(rng):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))


def expected(t):
    m = re.search(r"(\d+)", t)
    return dict(strip=t.strip(), ta=re.sub(r"[^a-z0-9\s]", " ", t.lower()).split(),
                tw=re.findall(r"\b\w+\b", t.lower()),
                pl=[x.strip() for x in t.split(",") if x.strip()],
                slug=t.split("view/")[-1].rstrip("/").lower(),
                dur=int(m.group(1)) if m else None,
                yn=t.lower() == "yes")


def test_text_functions_match_python(spark):
    rng = random.Random(13)
    texts = [rand_text(rng) for _ in range(2000)] + ["", " ", "\t a b \n", "view/a/view/B//", "YES"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.orderBy("i").select(
        TX.clean_text("t").alias("strip"), TX.tokenize_ascii("t").alias("ta"), TX.tokenize_words("t").alias("tw"),
        TX.parse_list_field("t").alias("pl"), TX.url_slug("t").alias("slug"), TX.parse_duration("t").alias("dur"),
        TX.yes_no_to_bool("t").alias("yn")).collect()
    bad = []
    for t, r in zip(texts, rows):
        for k, v in expected(t).items():
            if r[k] != v:
                bad.append((k, t, r[k], v))
    assert not bad, bad[:5]
