"""A tokenizer on the driver: vocabulary, processors, special tokens, and its JSON form."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from random import Random

from lexloom.functions.lattice import Lattice

VERSION = "2.0"
FORMS = ("nfc", "nfd", "nfkc", "nfkd")
PROCESSORS = ("crlf", *FORMS)


@dataclass(frozen=True)
class Token:
    value: bytes
    score: float
    keep: bool = False

    def to_json(self) -> dict:
        try:
            out: dict = {"value": self.value.decode(), "score": self.score}
        except UnicodeDecodeError:
            out = {"value": base64.b64encode(self.value).decode().rstrip("="), "score": self.score, "encoded": True}
        return out | ({"keep": True} if self.keep else {})

    @classmethod
    def from_json(cls, x: dict) -> Token:
        if unknown := set(x) - {"value", "score", "encoded", "keep"}:
            raise ValueError(f"unknown field of a token: {sorted(unknown)[0]}")
        for field in ("value", "score"):
            if field not in x:
                raise ValueError(f"a token lacks {field}")
        v = x["value"]
        value = base64.b64decode(v + "=" * (-len(v) % 4), validate=True) if x.get("encoded") else v.encode()
        return cls(value, float(x["score"]), bool(x.get("keep", False)))


def process(name: str, text: str) -> str:
    if name == "crlf":
        return text.replace("\r\n", "\n")
    if name in FORMS:
        return unicodedata.normalize(name.upper(), text)
    raise ValueError(f"no processor is called {name}; there are {', '.join(PROCESSORS)}")


def _processor_name(x: dict) -> str:
    kind = x.get("type", "crlf")
    name = x.get("form") if kind == "unicode" else kind
    if name not in PROCESSORS:
        raise ValueError(f"unknown processor {x}")
    return name


class Tokenizer:
    """Encodes and decodes; the id of a token is its place, special tokens come after the base ones."""

    def __init__(self, vocab: Iterable[Token], processors: Iterable[str] = (), special_tokens: Iterable[str] = ()) -> None:
        self.vocab = list(vocab)
        self.processors = list(processors)
        for p in self.processors:
            process(p, "")
        self._special: list[str] = []
        self._built()
        self.add_special_tokens(special_tokens)

    def _built(self) -> None:
        self.lattice = Lattice([t.value for t in self.vocab], [t.score for t in self.vocab])

    def __getstate__(self) -> str:
        return self.to_string()

    def __setstate__(self, state: str) -> None:
        self.__dict__.update(Tokenizer.from_str(state).__dict__)

    # vocabulary

    def add_special_tokens(self, tokens: Iterable[str]) -> None:
        for t in tokens:
            if not t:
                raise ValueError("a special token can't be empty")
            if t not in self._special:
                self._special.append(t)
        self._split = re.compile("|".join(map(re.escape, self._special))) if self._special else None
        self._special_id = {t: len(self.vocab) + i for i, t in enumerate(self._special)}

    def add_base_tokens(self, tokens: Iterable[Token]) -> None:
        """Appends tokens; the ids of special tokens move up."""
        self.vocab += tokens
        self._built()
        self.add_special_tokens(())

    def special_tokens(self) -> list[str]:
        return list(self._special)

    def base_vocab_size(self) -> int:
        return len(self.vocab)

    def special_vocab_size(self) -> int:
        return len(self._special)

    def vocab_size(self) -> int:
        return len(self.vocab) + len(self._special)

    def base_token_to_id(self, token: bytes) -> int | None:
        i = self.lattice.prefix.get(token, -1)
        return i if i >= 0 else None

    def special_token_to_id(self, token: str) -> int | None:
        return self._special_id.get(token)

    def token_to_id(self, token: bytes | str) -> int | None:
        raw = token.encode() if isinstance(token, str) else token
        found = self.base_token_to_id(raw)
        return found if found is not None else self._special_id.get(raw.decode(errors="replace"))

    def id_to_base_token(self, i: int) -> tuple[bytes, float] | None:
        return (self.vocab[i].value, self.vocab[i].score) if self.is_base(i) else None

    def id_to_special_token(self, i: int) -> str | None:
        return self._special[i - len(self.vocab)] if self.is_special(i) else None

    def id_to_token(self, i: int) -> bytes | None:
        return self.vocab[i].value if self.is_base(i) else self._special[i - len(self.vocab)].encode() if self.is_special(i) else None

    def is_base(self, i: int) -> bool:
        return 0 <= i < len(self.vocab)

    def is_special(self, i: int) -> bool:
        return len(self.vocab) <= i < self.vocab_size()

    def common_prefix_search(self, text: str | bytes) -> list[int]:
        raw = text.encode() if isinstance(text, str) else text
        return [t for _, t in self.lattice.matches(raw, 0)]

    # encoding

    def processed(self, text: str) -> str:
        for p in self.processors:
            text = process(p, text)
        return text

    def split(self, text: str) -> list[tuple[str, bool]]:
        """(piece, is it a special token): the earliest special token first, at one place the first of the list."""
        if self._split is None:
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self._split.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], False))
            out.append((m.group(), True))
            at = m.end()
        return out + ([(text[at:], False)] if at < len(text) else [])

    def encode_ordinary(self, text: str, dropout: float = 0.0, rng: Random | None = None) -> list[int]:
        return self.lattice.encode(self.processed(text).encode(errors="surrogatepass"), dropout, rng)

    def encode(self, text: str, dropout: float = 0.0, rng: Random | None = None) -> list[int]:
        out: list[int] = []
        for piece, special in self.split(text):
            out += [self._special_id[piece]] if special else self.encode_ordinary(piece, dropout, rng)
        return out

    def encode_batch(self, texts: Iterable[str], dropout: float = 0.0, rng: Random | None = None) -> list[list[int]]:
        return [self.encode(t, dropout, rng) for t in texts]

    def encode_ordinary_batch(self, texts: Iterable[str], dropout: float = 0.0, rng: Random | None = None) -> list[list[int]]:
        return [self.encode_ordinary(t, dropout, rng) for t in texts]

    def decode(self, ids: Iterable[int], include_special_tokens: bool = True) -> str:
        """The text; each run between special tokens is decoded by itself, bad bytes become U+FFFD."""
        out, run, base = [], [], len(self.vocab)
        for i in ids:
            if 0 <= i < base:
                run.append(self.vocab[i].value)
                continue
            if not base <= i < self.vocab_size():
                raise ValueError(f"id {i} is out of range")
            out.append(b"".join(run).decode(errors="replace"))
            run = []
            if include_special_tokens:
                out.append(self._special[i - base])
        return "".join(out) + b"".join(run).decode(errors="replace")

    def decode_batch(self, batch: Iterable[Iterable[int]], include_special_tokens: bool = True) -> list[str]:
        return [self.decode(ids, include_special_tokens) for ids in batch]

    # files

    def to_json(self) -> dict:
        forms = [{"type": "unicode", "form": p} if p in FORMS else {"type": p} for p in self.processors]
        return {"version": VERSION, "special_tokens": self._special, "processors": forms, "vocab": [t.to_json() for t in self.vocab]}

    def to_string(self) -> str:
        return json.dumps(self.to_json(), ensure_ascii=False, separators=(",", ":"))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_json(), f, ensure_ascii=False, indent=2)

    @classmethod
    def from_str(cls, text: str) -> Tokenizer:
        x = json.loads(text)
        if unknown := set(x) - {"version", "special_tokens", "processors", "vocab"}:
            raise ValueError(f"unknown field of a tokenizer: {sorted(unknown)[0]}")
        if x.get("version") != VERSION:
            raise ValueError(f"version {x.get('version')} isn't {VERSION}")
        return cls(map(Token.from_json, x.get("vocab", [])), map(_processor_name, x.get("processors", [])), x.get("special_tokens", []))

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls.from_str(f.read())
