"""Where the public tokenizer files are, and a few facts read from them."""

from __future__ import annotations

from .support import worker_cache


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@worker_cache
def piece_model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@worker_cache
def library_tokenizer(path: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)
