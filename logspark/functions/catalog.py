"""Fixed values of the block-log format, and what is derived from them."""

from __future__ import annotations

import re

# The published event templates of the block log, E1 to E29 in priority order.
# "[*]" stands for one or more characters.
TEMPLATE_TEXTS = [
    "Adding an already existing block[*]",
    "Verification succeeded for[*]",
    "Served block[*]to[*]",
    "Got exception while serving[*]to[*]",
    "Receiving block[*]src:[*]dest:[*]",
    "Received block[*]src:[*]dest:[*]of size[*]",
    "writeBlock[*]received exception[*]",
    "PacketResponder[*]for block[*]Interrupted[*]",
    "Received block[*]of size[*]from[*]",
    "PacketResponder[*]Exception[*]",
    "PacketResponder[*]for block[*]terminating[*]",
    "[*]:Exception writing block[*]to mirror[*]",
    "Receiving empty packet for block[*]",
    "Exception in receiveBlock for block[*]",
    "Changing block file offset of block[*]from[*]to[*]meta file offset to[*]",
    "[*]:Transmitted block[*]to[*]",
    "[*]:Failed to transfer[*]to[*]got[*]",
    "Starting thread to transfer block[*]to[*]",
    "Reopen Block[*]",
    "Unexpected error trying to delete block[*]BlockInfo not found in volumeMap[*]",
    "Deleting block[*]file[*]",
    "BLOCK* NameSystem[*]allocateBlock:[*]",
    "BLOCK* NameSystem[*]delete:[*]is added to invalidSet of[*]",
    "BLOCK* Removing block[*]from neededReplications as it does not belong to any file[*]",
    "BLOCK* ask[*]to replicate[*]to[*]",
    "BLOCK* NameSystem[*]addStoredBlock: blockMap updated:[*]is added to[*]size[*]",
    "BLOCK* NameSystem[*]addStoredBlock: Redundant addStoredBlock request received for[*]on[*]size[*]",
    "BLOCK* NameSystem[*]addStoredBlock: addStoredBlock request received for[*]on[*]size[*]But it does not belong to any file[*]",
    "PendingReplicationMonitor timed out block[*]",
]

# Events counted as errors.
ERROR_EVENTS = ["E4", "E7", "E8", "E10", "E11", "E12", "E14", "E17", "E20", "E24", "E29"]

# The session keys. The first keeps every hyphen and digit, the second one sign.
BLOCK_PATTERN = r"blk_[-\p{Nd}]+"
FIRST_BLOCK_PATTERN = r"(blk_-?\p{Nd}+)"

# Event for lines no template fits, width of its text, number of ids that are not numeric.
UNMATCHED_EVENT = "E0"
UNMATCHED_WIDTH = 80
NON_NUMERIC_EVENT = 9999

# Date, time, pid, level, component, content.
HEADER_FIELDS = ["date", "time", "pid", "level", "component", "content"]
_DIGIT, _WORD, _BLANK = r"\p{Nd}", r"\p{L}\p{N}_", r"[\p{IsWhite_Space}\x1c-\x1f]+"
# Flag d: only a line feed ends a line, so the content may hold any other character.
HEADER_PATTERN = (
    rf"(?d)^({_DIGIT}{{6}}){_BLANK}({_DIGIT}{{6}}){_BLANK}({_DIGIT}+){_BLANK}([{_WORD}]+){_BLANK}"
    rf"([{_WORD}.$]+):{_BLANK}(.+)$"
)

TEMPLATES = {f"E{number}": text for number, text in enumerate(TEMPLATE_TEXTS, 1)}


def pieces(text: str) -> list[str]:
    """Literal parts of a template, in order."""
    return [piece for piece in text.split("[*]") if piece]


def pattern(text: str) -> str:
    """Search pattern of a template: its literal parts with at least one character in between."""
    return ".+".join(re.sub(r"([\\.^$*+?{}\[\]|()])", r"\\\1", piece) for piece in pieces(text))
