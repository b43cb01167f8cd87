"""Pieces of SQL that several queries' oracles share."""


def crc32_sql(octets: str) -> str:
    """The unsigned CRC-32 of a list of bytes."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}))"
