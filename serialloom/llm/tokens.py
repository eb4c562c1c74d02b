"""Byte-level BPE ids inside tasks, from a public tokenizer's file."""

import json
from array import array
from functools import cached_property, lru_cache

#: Longer texts don't go to tiktoken, whose patterns give up on very long white space.
WHOLE = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    Where the file's merges make its tokens in the order of their ids, as they do in the
    public ones, the ids are what tiktoken makes of the same vocabulary, only faster. What
    a worker doesn't use it doesn't load.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            saved = json.load(file)
        #: What the file has added to its vocabulary; in a text it is read as that one id.
        self.added = [token["content"] for token in saved.get("added_tokens", [])]
        self.fast = self._same_by_ranks(saved)

    def _from_file(self, specials_as_text: bool):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = specials_as_text
        return made

    @cached_property
    def tokenizer(self):
        """As the file has it."""
        return self._from_file(False)

    @cached_property
    def plain(self):
        """For which added tokens in a text are text like any other."""
        return self._from_file(True)

    @cached_property
    def size(self) -> int:
        return self.plain.get_vocab_size(with_added_tokens=True)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        return [_bytes(self.plain.id_to_token(i) or "") for i in range(self.size)]

    def _same_by_ranks(self, saved: dict):
        import public_tokenizers
        import tiktoken

        model = saved["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        if saved.get("normalizer") or (saved.get("pre_tokenizer") or {}).get("add_prefix_space"):
            return None
        if [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {_bytes(token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """What the file's tokenizer makes of a text."""
        if text and any(token in text for token in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        """The same, but no text gives the id of an added token."""
        if not text:
            return b""
        if self.fast is not None and len(text) < WHOLE:
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.plain.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    return Encoder(path)


#: Byte-level vocabularies write a byte as a printable character: itself if it has one,
#: else the next free code point from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def _bytes(token: str) -> bytes:
    """What a token of the vocabulary stands for; added tokens stand for their own text."""
    return bytes(map(_BYTE.__getitem__, token)) if all(c in _BYTE for c in token) else token.encode()
