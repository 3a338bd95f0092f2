"""Token counts and quality rules against plain Python."""

import random

import pytest
from tidewheel.llm import quality, token_counts
from tidewheel.llm.common import WordTokens, public_path, tokenizer

BYTE_BPE = public_path("byte_bpe_50k.json")
PIECES = public_path("piece_bpe_32k.model")


def test_counts_are_the_librarys(corpus, nothing):
    tok = tokenizer(BYTE_BPE)
    counted = token_counts.token_counts(corpus, BYTE_BPE, chunk_chars=900, overlap_chars=16)
    rows = counted.collect()
    assert len(rows) == corpus.count()
    for row in rows:
        text = row["text"] or ""
        expected = len(tok.encode(text, add_special_tokens=False).ids)
        assert row["n_tokens"] == expected
        assert row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (expected > 1024)
    assert counted.columns[:6] == corpus.columns
    assert token_counts.token_counts(nothing, BYTE_BPE).count() == 0


HARD = [
    "x" * 700,
    "a " * 300,
    " " * 500 + "end",
    "it's we'll they've " * 40,
    "<|endoftext|>" * 60,
    "!!<|endoftext|>??" * 40,
    "日本語テキスト" * 90,
    "\n\n \t\n" * 120,
    "é" * 300,
    "12 345,678.9 " * 50,
    "😀👍🏽" * 120,
]


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("chunk, overlap", [(40, 4), (64, 20), (97, 1)])
def test_chunks_splice_to_the_whole(text, chunk, overlap):
    tok = tokenizer(BYTE_BPE)
    whole = len(tok.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_chunked(tok, text, chunk, overlap) == whole


def test_random_texts_splice_and_fall_into_pieces():
    tok, rng = tokenizer(BYTE_BPE), random.Random(3)
    letters = list("ab 'st \n\t.é日1<|>") + ["<|endoftext|>", "'ll", "  "]
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randint(0, 300)))
        whole = len(tok.encode(text, add_special_tokens=False).ids)
        assert token_counts.count_chunked(tok, text, 30, 5) == whole
        pieces = token_counts.pieces_of(text)
        assert "".join(pieces) == text
        assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in pieces) == whole


def brute_quality(text):
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    found = {}
    for i in range(n - 7):
        found.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = set()
    for places in found.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    lines = [x for x in data.split(b"\n") if x.split()]
    seen, again = set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    return {
        "n_words": n,
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": again,
        "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def test_base_measures(corpus, nothing):
    rows = quality.fertility_quality(corpus, PIECES).collect()
    assert len(rows) == corpus.count()
    for row in rows:
        expected = brute_quality(row["text"])
        assert {k: row[k] for k in expected} == expected
        assert not (row["kept"] and row["base_failed"])
    assert quality.fertility_quality(nothing, PIECES).count() == 0


def test_fertility_tells_noise_from_text(spark):
    words = (
        "They walked along the river until evening came and talked about how the old "
        "bridge had been built by people who never saw it finished although many had "
        "hoped to cross it before winter closed every road into town again"
    )
    noise = " ".join(f"\x02\x03\x04{i}\x05\x06" for i in range(60))
    caps = " ".join(["AAAA!! BBBB!! AAAA!! CCCC!!"] + [f"AAAA!! {c}!!" for c in "QXZJK" * 9])
    rows = spark.createDataFrame(
        [(1, words, "en"), (2, noise, "en"), (3, caps, None)],
        "doc_id bigint, text string, lang string",
    )
    kept = {r["doc_id"]: r["kept"] for r in quality.fertility_quality(rows, PIECES).collect()}
    assert kept == {1: True, 2: False, 3: False}
    strict = {"en": quality.Band((90.0, 99.0), 0.0, 0.99, least_tokens=1)}
    none = quality.fertility_quality(rows, PIECES, bands={**quality.BANDS, **strict})
    assert not [r for r in none.collect() if r["kept"] and r["lang"] == "en"]


def test_scripts():
    assert quality.script_of("plain") == "latin"
    assert quality.script_of("1234 ...") == "latin"
    assert quality.script_of("Привет, world") == "cyrillic"
    assert quality.script_of("日本語のテキスト") == "cjk"
    assert quality.script_of("한국어 글") == "hangul"


def test_word_cache_starts_over_when_full():
    cache = WordTokens(lambda words: [list(w) for w in words], limit=2)
    for words in ([b"ab", b"c"], [b"d", b"ab", b"ab"], [b"c"]):
        cache.make_room()
        numbers = cache.numbers(words, len(words))
        cache.settle()
        assert cache.ids(numbers).tolist() == list(b"".join(words))


def test_a_task_works_on_few_rows_and_gives_memory_back(monkeypatch):
    import pyarrow as pa
    from tidewheel.llm import common

    seen, given = [], []

    def run(batches):
        for batch in batches:
            seen.append(batch.num_rows)
            yield batch

    monkeypatch.setattr(common, "release", lambda: given.append(len(seen)))
    whole = [pa.record_batch({"id": list(range(2500))}), pa.record_batch({"id": [7]})]
    out = [v for b in common.lean(run)(iter(whole)) for v in b.column(0).to_pylist()]
    assert out == [*range(2500), 7]
    assert seen == [1000, 1000, 500, 1] and given == [4]


def test_memory_that_arrow_keeps_is_given_back():
    import pyarrow as pa
    from tidewheel.llm import common

    held = pa.array(range(100_000))
    common.release()
    assert held[99_999].as_py() == 99_999
