"""Token ids of whole texts by a byte-level BPE vocabulary, with the texts' chunks remembered per task."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Chunks a task remembers at once; beyond, the memory is emptied and fills again with the chunks in use.
REMEMBERED = 200_000
#: White space in Unicode that is not ASCII white space: a text with it is encoded in one piece.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: White space followed by other characters: in byte-level BPE no token crosses the border between two of these,
#: as the splitting pattern never matches white space after anything but white space.
_CHUNK = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")


class BytePairs:
    """``encode(text)``: ids as little-endian unsigned 32-bit bytes. Equal to the ``tokenizers`` library's ids for the
    vocabulary in ``json_path`` without added special tokens; ``ranks_path`` holds the same vocabulary as ranks."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        lines = (line.split() for line in open(ranks_path, "rb") if line.strip())
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in lines}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}

    def chunk(self, text: str) -> bytes:
        found = self.seen.get(text)
        if found is None:
            found = np.array(self.core.encode_ordinary(text), dtype="<u4").tobytes()
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(text) <= 64:
                self.seen[text] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text.isascii() and _WIDE.search(text) or text.isascii() and re.search("[\x1c-\x1f]", text):
            return self.chunk(text)
        return b"".join(map(self.chunk, _CHUNK.findall(text)))
