"""Places of the public tokenizers' vocabulary files; they are read where they are installed, never copied."""

from __future__ import annotations

import public_tokenizers

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
