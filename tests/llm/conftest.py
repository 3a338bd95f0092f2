import random

import pytest

from corpus_words import sentence
from tidewheel.llm.common import ship

@pytest.fixture(scope="session", autouse=True)
def library(spark):
    ship(spark)


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, repeats inside, odd spaces, and
    nothing at all."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(5, 120)) for _ in range(40)]
    passage = sentence(rng, 60)
    out = [" ".join(b) for b in base]
    out += [" ".join(base[0])] * 12
    for k in range(25):
        near = list(base[1])
        near[k * 3 % len(near)] = f"edit{k}"
        out.append(" ".join(near))
    out += [" ".join([*sentence(rng, 15), *passage, *sentence(rng, 9)]) for _ in range(8)]
    out += ["la la la " * 40, "\n".join(["one line of words to say again"] * 30)]
    out += ["  lead\t and\x0b trail \r\n ", "a b c", "A B C", "a", None, "", " \n\t "]
    out += ["\x1c sep nbsp　wide \x85 next " * 3]
    out += [" ".join(sentence(rng, 6000))]
    return out


@pytest.fixture(scope="session")
def corpus(spark, texts):
    """The texts as documents, with a null id, repeated rows, null source and language,
    and columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3 if i % 5 else 0}", "x", "y") for i, t in enumerate(texts)]
    rows += [(None, "no id here " * 9, None, None, None, None)] * 2
    rows += [rows[3], rows[3]]
    schema = (
        "doc_id bigint, text string, lang string, source string, `_row` string, tokens string"
    )
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)
