import itertools
import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load())


def test_ids_equal_the_librarys_on_words(library, encoder):
    random.seed(1)
    vocabulary = [p for p in encoder.id if len(p) > 1]
    texts = ["".join(random.choices(vocabulary, k=random.randint(1, 5))).replace(pieces.MARK, random.choice([" ", ""])) for _ in range(20_000)]
    for t, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(t), t


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\tabcdeéßth%|#-", max_size=60)))
def test_any_text(library, encoder, text):
    (ids,) = encoder.encode_all([text])
    assert ids.tolist() == library.encode(text)
    assert encoder.decode(ids) == text.replace(pieces.MARK, " ")


def test_unigram_takes_the_best_path():
    model = pieces.load()
    own = pieces.Encoder(model._replace(scores=[-1.0 - (i % 97) / 10 for i in range(len(model.pieces))], kind="unigram"))

    def best(word):
        found = {0: (0.0, [])}
        for i in range(1, len(word) + 1):
            found[i] = max((found[j][0] + own.score[word[j:i]], [*found[j][1], word[j:i]]) for j in range(i) if word[j:i] in own.id)
        return found[len(word)][0]

    words = [pieces.MARK + w for w in ("there", "therefore", "thermal", "x", "hello", "internationalisation")]
    for w, ids in own._sorted(sorted(words)):
        found = [model.pieces[i] for i in ids]
        assert "".join(found) == w and sum(own.score[p] for p in found) == pytest.approx(best(w))


def test_query(spark, library, tmp_path):
    texts = [None, "", " ", "a  b\n\n c", "é漢😀", "x" * 30_000, "word " * 20_000, "same", "same", "a▁b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op3_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert found[i].token_ids == library.encode(t or "") and found[i].n_tokens == len(found[i].token_ids)
        assert found[i].round_trip == (pieces.MARK not in (t or ""))
    back = pieces.decode(queries.op3_sentencepiece(spark, str(tmp_path))).collect()
    assert {r.doc_id: r.decoded for r in back} == {i: (t or "").replace(pieces.MARK, " ") for i, t in enumerate(texts)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op3_sentencepiece(spark, str(tmp_path)).count() == 0


def test_long_runs_of_blanks_are_quick(library, encoder):
    for t in (" " * 1_000_000, "a" + " " * 200_000 + "b", "▁" * 100_000, " " * 4097 + "x"):
        began = time.perf_counter()
        (ids,) = encoder.encode_all([t])
        assert time.perf_counter() - began < 20
        assert ids.tolist() == library.encode(t)


def test_unigram_path_over_characters_without_a_piece():
    model = pieces.load()
    vocabulary = {"▁": -2.0, "a": -1.5, "ab": -2.5, "bc": -1.0, "abc": -6.0, "▁c": -3.0, "▁bcd": -2.0}  # neither b, c nor d is a piece
    kept = [p for i, p in enumerate(model.pieces) if i in model.byte_ids or i in model.special]
    own = model._replace(
        pieces=[*kept, *vocabulary], scores=[0.0] * len(kept) + list(vocabulary.values()), kind="unigram",
        byte_ids=[kept.index(f"<0x{b:02X}>") for b in range(256)], special=[kept.index(model.pieces[i]) for i in model.special],
    )
    encoder = pieces.Encoder(own)

    def best(word):
        found = {0: 0.0}
        for i in range(1, len(word) + 1):
            ways = [found[j] + vocabulary[word[j:i]] for j in range(i) if word[j:i] in vocabulary]
            found[i] = max(ways + [found[i - 1] + encoder.unknown] * (word[i - 1] not in vocabulary))
        return found[len(word)]

    words = sorted({"▁" + "".join(w) for n in range(1, 6) for w in itertools.product("abcd", repeat=n)})
    for w, ids in encoder._sorted(words):
        said = [own.pieces[i] if i >= 0 else chr(-2 - i) for i in ids]
        assert "".join(said) == w
        assert sum(vocabulary.get(p, encoder.unknown) for p in said) == pytest.approx(best(w)), (w, said)
    assert [own.pieces[i] for i in dict(encoder._sorted(["▁ab"]))["▁ab"]] == ["▁", "ab"]
