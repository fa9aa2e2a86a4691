"""Where the vocabularies of the public tokenizers lie; they are installed on every machine and never copied."""

import public_tokenizers

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
