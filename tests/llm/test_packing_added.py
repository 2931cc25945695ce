import numpy as np
import pytest

from tabulark.llm import packing


@pytest.mark.parametrize("text", ["end <|endoftext|> start", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n <|endoftext", "x  <|endoftext|>y"])
def test_added_token_is_found_in_texts(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    bpe = packing.ByteBpe(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    reference = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert np.frombuffer(bpe.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
