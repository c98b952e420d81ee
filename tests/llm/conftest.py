import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, bucket string, part string, _key string, row string"
SYLLABLES = "the an in or er st wh re ed ing tion ly ha ou ea nd th on es it".split()
PASSAGE = " ".join(f"passage{i} shared" for i in range(40))
LINE = "This line stands in very many documents of the set."


def sentence(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows():
    r = random.Random(7)
    out = [(i, sentence(r, r.randint(60, 200))) for i in range(1, 25)]
    base = sentence(r, 240)
    out += [(30 + i, base) for i in range(4)]  # copies
    for i in range(6):  # near copies, each of the base
        w = base.split()
        for _ in range(2 + i):
            w[r.randrange(len(w))] = f"new{i}"
        out.append((40 + i, " ".join(w)))
    out += [
        (
            50 + i, sentence(r, 70) + "\n" + LINE.upper() * (i % 2) + LINE * (1 - i % 2) + "  \n" + sentence(r, 5)
        ) for i in range(5)
    ]
    out += [(60 + i, sentence(r, 30 * i) + " " + PASSAGE + " " + sentence(r, 20)) for i in range(4)]
    out += [
        (70, None), (71, ""), (72, " \n\t "), (73, "x"), (74, "a b"), (75, "a b"), (76, "ONE two\nthree"),
        (77, "one TWO three")
    ]
    out += [
        (80, "la la la " * 40), (81, "\n".join([LINE] * 3 + ["short"] * 4)),
        (82, "<|endoftext|> it's x<|startoftext|>y. ΑΒΣ é é 日本語 🙂"), (83, "café wide\u0085next \x1c z" * 3)
    ]
    out += [
        (
            90,
            "mail a.b@c-d.org_e@f.gh, 1.2.3.4.5 300.1.1.1 and 4111 1111 1111 1111 or +1 (555) 010-9999. +12-3 a@b@c.de " + sentence(r, 50)
        )
    ]
    out += [(100, sentence(r, 20_000)), (101, "z" * 50_000), (102, "7" * 30_000), (103, "la di da " * 7_000)]
    out += [
        (1, out[0][1]), (1, out[0][1]), (2, "another text of a known id " + sentence(r, 60)), (None, sentence(r, 80)),
        (None, base), (-5, base + " tail")
    ]
    return out


@pytest.fixture(scope="session")
def docs_rows():
    return rows()


def frame(spark, rows_):
    langs = ["en", "fr", None, "de"]
    return spark.createDataFrame(
        [
            (
                d, t, langs[i % 4], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), *["clash"] * 6
            ) for i, (d, t) in enumerate(rows_)
        ],
        SCHEMA
    )


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return frame(spark, docs_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items_rows():
    return [
        (1, PASSAGE), (2, " ".join(PASSAGE.split()[10:40])), (3, "one TWO, three"), (4, None), (5, ""),
        (6, "unseen words that no document of the fixture holds anywhere at all in this order"), (1, PASSAGE),
        (11, "a b")
    ]


@pytest.fixture(scope="session")
def items(spark, items_rows):
    return spark.createDataFrame(items_rows, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, 1, 0) for i in range(1, 20)] + [(1, 1, 0), (80, 0, 0), (60, 1, 1), (None, 1, 0), (61, None, None)],
        "doc_id long, quality int, toxic int"
    )
