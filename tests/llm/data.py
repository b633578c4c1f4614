"""Small documents with the cases that operators must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, h string, token string, node long"


def texts(seed: int = 1) -> list:
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "zeta", "x", "don't", "42", "naïve", "日本", "omega"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(n))
    shared = prose(90)
    base = [prose(r.choice([3, 20, 80, 200])) for _ in range(40)]
    near = [x.replace("alpha", "ALPHA", 1) + " tail" for x in base[:10]]
    private = [
        "write to a.b+c@mail.example.org or b@x.y.z_c@d.e now, badge 77812 zorblat",
        "reach 10.0.0.255 not 10.0.0.256 nor 1.2.3 but 1.2.3.4.5.6.7.8 zorblat",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 00000000000000",
        "call +1 (415) 555-0100 or +12 or +49.30.1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
        "Zorblat handles a.b+c@mail.example.org daily",
        "the zorblat desk: A.B+C@mail.example.org",
        "zorblat a.b+c@mail.example.org é 日本 \U0001f600 a.b+c@mail.example.org",
        "@ a@ @b.c a@b a@b. é@b.c 1..2.3.4 + +- 5",
    ]
    odd = [None, "", " ", "\t\n", "a", "a" * 1500, "word " * 3000, "日" * 500]
    return base + base[:5] + near + private + [shared + " one " + prose(5), prose(5) + " two " + shared, shared] + odd + [None, ""]


def rows(seed: int = 1) -> list:
    out = [(i * 3, x, ["en", "fr", None][i % 3], "s", None, "x", "y", "t", 5) for i, x in enumerate(texts(seed))]
    return out + [out[0], out[1], (None, "no id here", None, None, None, None, None, None, None)]


def frame(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA).repartition(3)
