"""Pre-tokens of a tokenizers file whose words are merged one by one, and their ids.

The library's own normaliser, pre-tokenizer and model stay the authority. For texts made of common Latin
characters the same normalisation and split are done by str.lower and one pattern, which is much faster;
every other text goes through the library's objects.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

# A task has one core; the library's own threads would only take it from other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Regex, Tokenizer, pre_tokenizers  # noqa: E402

#: Characters for which lower() equals the library's lower-casing, NFC changes nothing and white space is undisputed.
_ALPHABET = "\t\n\r -~¡-įı-ſ‐-‧"
_plain = re.compile(f"[^{_ALPHABET}]").search


def _members(category: str) -> str:
    """Class text of the lower-case characters of the alphabet in a Unicode category."""
    chars = [c for c in map(chr, range(0x2030)) if re.match(f"[{_ALPHABET}]", c) and unicodedata.category(c)[0] == category and c == c.lower()]
    return "".join(map(re.escape, chars))


class WordTokenizer:
    """Splits texts into pre-tokens and gives the ids of a pre-token."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        config = json.loads(self.whole.to_str())
        pretok = config["pre_tokenizer"]["pretokenizers"][0]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.n_ids = max([*self.whole.get_vocab().values(), *self.special.values()]) + 1
        self.find_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        # The same pattern with the alphabet's letters and numbers spelt out, which the plain engine matches faster.
        self.pattern = re.compile(pretok["pattern"]["Regex"].replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"\s\p{L}\p{N}", f"\\s{_members('L')}{_members('N')}").replace(r"\p{L}", f"[{_members('L')}]").replace(r"\p{N}", f"[{_members('N')}]")).findall
        self.bare = Tokenizer(self.whole.model)  # one pre-token at a time, no normaliser
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.normalize = self.whole.normalizer.normalize_str
        self.presplit = pre_tokenizers.Split(Regex(pretok["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; a special string found in the text is one of them."""
        if _plain(text) is None and (not self.special or "<|" not in text or self.find_special.search(text) is None):
            return self.pattern(text.lower())
        out, start = [], 0
        for match in [*self.find_special.finditer(text), None]:
            segment = self.normalize(text[start : match.start() if match else len(text)])
            out += [piece for piece, _ in self.presplit(segment)]
            if match:
                out.append(match[0])
                start = match.end()
        return out

    def ids(self, pretokens: Iterable[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        wanted = list(pretokens)
        found = self.bare.encode_batch_fast(wanted, add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(wanted, found, strict=True)]


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file and worker process, kept from task to task."""
    return WordTokenizer(path)
