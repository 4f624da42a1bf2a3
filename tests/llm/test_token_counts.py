import sentencepiece

from cases import frame, texts
from folioflow.llm.common import tokenizer_path
from folioflow.llm.token_counts import count_tokens


def test_equals_the_library_on_whole_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    made = texts() + [a + b for a in (" ", "\n", "  ", "x") for b in ("\n ", " \n", "▁", " y  z")]
    got = {r.doc_id: r for r in count_tokens(frame(spark, enumerate(made)), limit=50).collect()}
    assert len(got) == len(made)
    for i, t in enumerate(made):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50), repr(t)


def test_no_rows_and_repeated_rows(spark):
    assert count_tokens(frame(spark, [])).collect() == []
    assert len(count_tokens(frame(spark, [(1, "a b")] * 3)).collect()) == 3
