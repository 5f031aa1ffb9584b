import pytest

#: Columns beside those of documents, named like columns that operators add or work with.
CLASHES = "row key size media score id y rank part got runs n_words n_removed kept epoch block keep target taken same rep n l hot_key center bucket blob others text_score numbers rid xt xm vslot h nth shard slot base dealt before ids tokens".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)


def lines(rnd, n, words=("the", "of", "and", "ab", "cd", "ef", "gh", "ij", "kl", "mn", "Op", "qr,", "st.", "uv", "wx")):
    return " ".join(rnd.choice(words) + str(rnd.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, shared passages, odd white space, nulls, repeats and clashing columns."""
    import random

    rnd = random.Random(11)
    base = [lines(rnd, rnd.randrange(1, 120)) for _ in range(40)]
    passage = lines(rnd, 30)
    texts = list(base)
    for i in range(12):
        w = base[i].split()
        if w:
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[0]] * 5 + [f"{lines(rnd, 5)} {passage} {lines(rnd, 7)}" for _ in range(6)]
    texts += [None, "", "   ", "one", "\t\n\x0b\x0c\r x \xa0y  z ", "İ ǅ ß <|endoftext|> 'tis", lines(rnd, 5000), "tie tie tie tie tie tie tie tie tie tie tie tie tie tie", "tie " * 20]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"src{i % 5 if i % 2 else 0}", len(t) if t else None, *CLASHES) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id at all", None, None, None, *CLASHES)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
