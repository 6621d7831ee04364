"""What the driver holds of a plan does not grow with the vocabulary."""

import public_tokenizers

from quarry.llm import bpe


def test_ranks_are_not_written_out_in_the_plan(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "doc_id long, text string")
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    assert len(found._jdf.queryExecution().toString()) < 200_000
    tokens = {rank: token for token, rank in ranks.items()}
    assert sorted((r.doc_id, bpe.decode(r.ids, tokens)) for r in found.collect()) == [(1, b"two words"), (2, b""), (3, b"")]
