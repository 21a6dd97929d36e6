import zlib

import numpy as np
from public_tokenizers import path

from tickloom.llm import token_files

VOCABULARY = path("byte_bpe_50k.json")


def test_names_of_added_tokens_are_one_token_as_in_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(VOCABULARY), token_files.pieces(VOCABULARY)
    texts = ["a <|endoftext|> x", "<|endoftext|>", "<|endoftext|>x<|endoftext|>\n y", "a<|endoftext| >", "plain, text  here", "<|endoftext|> "]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 2124]
    assert [np.frombuffer(model.ids(t), "<u4").tolist() for t in texts] == want
    token_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), str(tmp_path / "out"), VOCABULARY)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, str(tmp_path / "out")).collect()}
    at = 0
    for i, ids in enumerate(want):
        ids = np.array([*ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
