"""Pieces of public tokenizers: exact cuts of long texts, pre-tokens, ids."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: Texts are cut after about so many characters, at places no pre-token spans.
CUT_CHARS = 1 << 16

#: The special string of the byte-level vocabulary and its id (fixed values).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

#: A blank between a character that is no white space and a letter always begins a pre-token.
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")
# Letters, numbers and white space up to Latin Extended-B (fixed values of Unicode).
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: The published pattern of pre-tokens, spelled out for those characters.
_PRE_TOKEN = re.compile(
    rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
#: Characters that every Unicode version of the libraries classes alike: Basic Latin to Latin
#: Extended-B, and general punctuation without its spaces and invisible marks.
_OTHER = re.compile("[^\\x00-ɏ‐-‧‰-⁞€]")


def cuts(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """Parts of a text whose ids, one after the other, are the ids of the text."""
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def ranks(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary as ranks, with its special string."""
    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={SPECIAL: SPECIAL_ID}
    )


def ids(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids of a text as the tokenizers library gives them, without added tokens.

    The rank file is the same vocabulary and several times faster; it is asked
    only where both libraries class all characters alike. Other parts go to
    the tokenizers library itself.
    """
    out = []
    for part in cuts(text):
        if len(part) <= 2 * CUT_CHARS and (part.isascii() or not _OTHER.search(part)):
            out.append(ranks(ranks_path).encode_to_numpy(part, allowed_special="all"))
        else:
            out.append(np.array(tokenizer(json_path).encode(part, add_special_tokens=False).ids, np.uint32))
    return np.concatenate(out).astype(np.uint32, copy=False)


def pre_tokens(text: str, json_path: str) -> Iterator[list[str]]:
    """Lists of the pre-tokens of a text, special strings left as they are.

    Parts with other characters than the spelled-out pattern knows are split
    by the tokenizer's own splitter.
    """
    for part in cuts(text):
        plain = part.isascii() or not _OTHER.search(part)
        for i, piece in enumerate(part.split(SPECIAL)):
            if i:
                yield [SPECIAL]
            if not piece:
                continue
            if plain:
                yield _PRE_TOKEN.findall(piece)
            else:
                splitter = tokenizer(json_path).pre_tokenizer
                yield [piece[a:b] for _, (a, b) in splitter.pre_tokenize_str(piece)]
