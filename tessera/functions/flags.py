"""Predicates on packed flags of nodes, changes and fragments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a node's flags.
FILE = 0b1
LINK = 0b10
DIRTY = 0b1000
STAGED = 0b10000
STAGED_ACTION = {"Modify": 0b110000, "Add": 0b1010000, "Delete": 0b10010000, "Move": 0b100010000, "Copy": 0b1000010000}
STAGED_MERGE = 0b10000010000
STAGED_MERGE_CONFLICT = 0b110000010000
STAGED_MERGE_RESOLVED = 0b1110000010000
STAGED_MERGE_MINE = 0b10010000010000
STAGED_MERGE_THEIRS = 0b100010000010000
STAGED_BITS = 0b111111111110000
ACTION_BITS = 0b1111100000
MERGE_BITS = 0b111110000000000

# The bits of a change's flags.
CHANGE_MODIFY = 0b1
CHANGE_MERGE = 0b10
CHANGE_CONFLICT = 0b110
CHANGE_RESOLVED = 0b1110
CHANGE_MINE = 0b100110
CHANGE_THEIRS = 0b1000110
CHANGE_STAGED = 0b10000000
CHANGE_DIRTY = 0b100000000

# The bits of a fragment's flags, and the largest payload.
FRAGMENTED = 0b1
LZ4 = 0b10
OODLE2 = 0b100
ZSTD = 0b1000
COMPRESSED = 0b11111110
OBLITERATED = 0b100000000
OBLITERATION = 0b1100000000
KNOWN_FRAGMENT_BITS = 0b1111110000001111111111
LARGEST_PAYLOAD = 256 * 1024


def has(flags: Column, mask: int) -> Column:
    """Whether all bits of ``mask`` are set."""
    return flags.bitwiseAND(F.lit(mask)) == mask


def is_staged(flags: Column) -> Column:
    return has(flags, STAGED)


def is_dirty(flags: Column) -> Column:
    return has(flags, DIRTY)


def is_changed(flags: Column) -> Column:
    """Whether any bit of a change, dirty or staged, is set."""
    return flags.bitwiseAND(F.lit(DIRTY | STAGED_BITS)) != 0


def kind(flags: Column) -> Column:
    return F.when(has(flags, FILE), "file").when(has(flags, LINK), "link").otherwise("directory")


def action(flags: Column) -> Column:
    """What a node's flags do to it: deletion before addition, move, copy; else it is kept."""
    out = F.lit("Keep")
    for name in ("Copy", "Move", "Add", "Delete"):
        out = F.when(has(flags, STAGED_ACTION[name]), name).otherwise(out)
    return out


def staged_action(flags: Column) -> Column:
    """As ``action``, for staged nodes alone, with modification told apart; null for none."""
    out = F.when(has(flags, STAGED_ACTION["Modify"]), "Modify")
    for name in ("Copy", "Move", "Add", "Delete"):
        out = F.when(has(flags, STAGED_ACTION[name]), name).otherwise(out)
    return F.when(is_staged(flags), out)


def is_unresolved(flags: Column) -> Column:
    return has(flags, STAGED_MERGE_CONFLICT) & ~has(flags, STAGED_MERGE_RESOLVED)


def change_flags(flags: Column, act: Column, in_target: Column) -> Column:
    """Flags of the change that a node stands for; a kept file without a node on the other side is a modification."""
    out = F.when((act == "Keep") & ~in_target, CHANGE_MODIFY).otherwise(0)
    pairs = (
        (STAGED, CHANGE_STAGED), (DIRTY, CHANGE_DIRTY), (STAGED_MERGE, CHANGE_MERGE), (STAGED_MERGE_CONFLICT, CHANGE_CONFLICT),
        (STAGED_MERGE_RESOLVED, CHANGE_RESOLVED), (STAGED_MERGE_MINE, CHANGE_MINE), (STAGED_MERGE_THEIRS, CHANGE_THEIRS),
    )
    for mask, bits in pairs:
        out = out.bitwiseOR(F.when(has(flags, mask), bits).otherwise(0))
    return out


def clear_staged(flags: Column) -> Column:
    """Without what staging set; the action stays where the node is dirty too."""
    kept = flags.bitwiseAND(F.lit(~(STAGED | MERGE_BITS)))
    return F.when(is_dirty(flags), kept).otherwise(kept.bitwiseAND(F.lit(~ACTION_BITS)))


def clear_dirty(flags: Column) -> Column:
    """Without the dirty mark; the action stays where the node is staged too."""
    kept = flags.bitwiseAND(F.lit(~DIRTY))
    return F.when(is_staged(flags), kept).otherwise(kept.bitwiseAND(F.lit(~ACTION_BITS)))


def resolve(flags: Column, side: str) -> Column:
    """A conflict settled by ``mine`` or ``theirs``; other nodes as they are."""
    bits = STAGED_MERGE_RESOLVED | (STAGED_MERGE_MINE if side == "mine" else STAGED_MERGE_THEIRS)
    return F.when(has(flags, STAGED_MERGE_CONFLICT), flags.bitwiseOR(F.lit(bits))).otherwise(flags)


def unresolve(flags: Column) -> Column:
    """A settled conflict opened again."""
    settled = (STAGED_MERGE_RESOLVED | STAGED_MERGE_MINE | STAGED_MERGE_THEIRS) & ~STAGED_MERGE_CONFLICT
    return F.when(has(flags, STAGED_MERGE_CONFLICT), flags.bitwiseAND(F.lit(~settled))).otherwise(flags)


def compression(flags: Column) -> Column:
    """The name of a fragment's compression."""
    return (
        F.when(flags.bitwiseAND(F.lit(COMPRESSED)) == 0, "not_compressed")
        .when(has(flags, LZ4), "lz4")
        .when(has(flags, OODLE2), "oodle2")
        .when(has(flags, ZSTD), "zstd")
        .otherwise("unknown")
    )


def fragment_fault(flags: Column, payload: Column, content: Column) -> Column:
    """The first rule that a fragment's metadata breaks, or null."""
    packed = flags.bitwiseAND(F.lit(COMPRESSED))
    fragmented = has(flags, FRAGMENTED)
    return (
        F.when(flags.bitwiseAND(F.lit(~KNOWN_FRAGMENT_BITS)) != 0, "unknown bits")
        .when(flags.bitwiseAND(F.lit(OBLITERATION)) != 0, "obliteration")
        .when(F.bit_count(packed) > 1, "several compressions")
        .when(packed.bitwiseAND(F.lit(~(LZ4 | OODLE2 | ZSTD))) != 0, "reserved compression")
        .when((packed != 0) & fragmented, "compressed list")
        .when(payload == 0, "no payload")
        .when(payload > content, "payload beyond content")
        .when((packed != 0) & (content > LARGEST_PAYLOAD), "too large to compress")
        .when((packed == 0) & ~fragmented & (payload != content), "sizes differ")
    )


def next_level(level: Column, step: int = 1) -> Column:
    """The match level (0 to 3) one step up or down, kept in range."""
    return F.greatest(F.lit(0), F.least(F.lit(3), level + step))
