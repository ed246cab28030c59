"""String, address and key functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extension and media type.
MEDIA_TYPES = {
    "mp4": "video/mp4",
    "mkv": "video/x-matroska",
    "webm": "video/webm",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "pdf": "application/pdf",
    "html": "text/html",
    "htm": "text/html",
    "css": "text/css",
    "js": "application/javascript",
    "json": "application/json",
    "xml": "application/xml",
    "txt": "text/plain",
    "zip": "application/zip",
    "tar": "application/x-tar",
    "gz": "application/gzip",
}
OTHER_MEDIA = "application/octet-stream"


def media_type(name: Column) -> Column:
    """Media type by what follows the last dot (the whole name if there is none)."""
    pairs = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, F.lower(F.substring_index(name, ".", -1))), F.lit(OTHER_MEDIA))


def safe_filename(name: Column) -> Column:
    """Letters, digits, dot, hyphen, underscore and space stay; control characters go; the rest becomes an underscore. 255 characters at most."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1F\x7F-\x{9F}]", ""), r"[^A-Za-z0-9._ -]", "_")
    return F.when(kept == "", "download").otherwise(F.substring(kept, 1, 255))


def byte_range(header: Column, size: Column) -> Column:
    """(start, stop, ranged) of one `bytes=` range, clamped; anything else, and several ranges, is the whole file."""
    body = F.when(header.startswith("bytes="), F.substr(header, F.lit(7)))
    suffix = F.regexp_extract(body, r"^-([0-9]{1,18})$", 1)
    low = F.regexp_extract(body, r"^([0-9]{1,18})-[0-9]{0,18}$", 1)
    high = F.regexp_extract(body, r"^[0-9]{1,18}-([0-9]{1,18})$", 1)
    last = size - 1
    tail = F.try_to_number(suffix, F.lit("9" * 18)).cast("bigint")
    first = F.try_to_number(low, F.lit("9" * 18)).cast("bigint")
    stop = F.try_to_number(high, F.lit("9" * 18)).cast("bigint")
    start = F.when(tail > 0, F.greatest(size - tail, F.lit(0))).when(first.isNotNull(), first)
    ranged = F.coalesce(start.isNotNull() & (size > 0), F.lit(False))
    end = F.when(tail > 0, last).otherwise(F.coalesce(stop, last))
    top = F.greatest(last, F.lit(0))
    return F.struct(
        F.when(ranged, F.least(start, top)).otherwise(0).cast("bigint").alias("start"),
        F.when(ranged, F.least(end, top)).otherwise(top).cast("bigint").alias("stop"),
        ranged.alias("ranged"),
    )


def is_file_hash(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def sharded_path(hash_hex: Column) -> Column:
    """aa/bb/hash.bin, a folder for each of the first two bytes."""
    return F.concat(F.substring(hash_hex, 1, 2), F.lit("/"), F.substring(hash_hex, 3, 2), F.lit("/"), hash_hex, F.lit(".bin"))


def epoch_key(epoch: Column) -> Column:
    return F.concat(F.lit("cluster_map_epoch:"), epoch.cast("string"))


def group_page_key(group: Column, page: Column) -> Column:
    return F.concat(F.lit("pg_index:pg:"), group.cast("string"), F.lit(":page:"), page.cast("string"))


def group_meta_key(group: Column) -> Column:
    return F.concat(F.lit("pg_index:meta:"), group.cast("string"))


def bearer(header: Column) -> Column:
    return F.when(header.startswith("Bearer "), F.substr(header, F.lit(8)))


def host_of(address: Column) -> Column:
    """The host of an address: scheme, path and port removed."""
    bare = F.regexp_extract(address, r"^(?:https?://)?([^/]*)", 1)
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[+([^\]]*)", 1)).otherwise(F.regexp_replace(bare, r":[^:]*$", ""))


def octets(host: Column) -> Column:
    """Four octets of a dotted address, or null."""
    good = host.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    return F.when(good, F.transform(F.split(host, r"\."), lambda x: x.cast("int")))


def advertisable(o: Column) -> Column:
    """Whether a node may announce the address (of four octets): private ranges may, special ones may not."""
    special = (o[0] == 127) | (o[0] == 0) & (o[1] == 0) & (o[2] == 0) & (o[3] == 0) | (o[0] == 169) & (o[1] == 254) | (o[0] >= 224)
    return ~special


def routable(o: Column) -> Column:
    """Whether the address (of four octets) can be reached from anywhere."""
    private = (o[0] == 10) | (o[0] == 172) & o[1].between(16, 31) | (o[0] == 192) & (o[1] == 168) | (o[0] == 100) & o[1].between(64, 127)
    return advertisable(o) & ~private


def dedup_key(shard: Column, miner: Column, seed_hex: Column) -> Column:
    return F.concat_ws(":", shard, miner.cast("string"), seed_hex)


def truncated(value: Column, most: int) -> Column:
    """The first characters of a string, or bytes of a binary."""
    return F.substring(value, 1, most)


def bytes32(value: Column) -> Column:
    """32 bytes out of 64 hex digits, with or without 0x; null otherwise."""
    bare = F.regexp_replace(value, "^0x", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{64}$"), F.unhex(bare))


def account_bytes(value: Column) -> Column:
    """32 bytes of an account: hex as it is, anything else by its hash."""
    return F.coalesce(bytes32(value), F.unhex(F.sha2(value, 256)))


def little_endian(value: Column, size: int) -> Column:
    """A number as `size` bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def prefixed(value: Column) -> Column:
    """Bytes after their length in compact form: one, two or four bytes whose lowest two bits tell which."""
    n = F.octet_length(value).cast("bigint")
    length = F.when(n < 64, little_endian(n * 4, 1)).when(n < 1 << 14, little_endian(n * 4 + 1, 2)).otherwise(little_endian(n * 4 + 2, 4))
    return F.concat(length, value)


def signed_bytes(tag: str, shard: Column, uid: Column, result: Column, challenge: Column, block: Column, second: Column, proof: Column, warden: Column) -> Column:
    """The bytes that an attestation's signature covers.

    A domain tag, the shard's hash, the proof's digest (bytes, may be empty) and the warden's id are prefixed by their lengths; uid has four bytes, the
    result's number one, block and second eight each, and the challenge's 32 bytes stand as they are.
    """
    return F.concat(
        prefixed(F.lit(tag.encode())), prefixed(F.encode(shard, "UTF-8")), little_endian(uid, 4), little_endian(result, 1), challenge,
        little_endian(block, 8), little_endian(second, 8), prefixed(proof), prefixed(F.encode(warden, "UTF-8")),
    )


def field_elements(data: Column) -> Column:
    """Binary data as numbers of three bytes each, the lowest byte first, and its length after them."""
    n = F.octet_length(data)

    def byte(place: Column) -> Column:
        return F.coalesce(F.conv(F.hex(F.substr(data, place, F.lit(1))), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))

    cells = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 3).cast("int"), F.lit(1)) - 1), lambda k: byte(k * 3 + 1) + byte(k * 3 + 2) * 256 + byte(k * 3 + 3) * 65_536)
    return F.concat(F.when(n > 0, cells).otherwise(F.array().cast("array<bigint>")), F.array(n.cast("bigint")))


def element_bytes(elements: Column, count: int = 8) -> Column:
    """So many numbers of 32 bits as bytes, the lowest byte of each first."""
    return F.concat(*(little_endian(F.get(elements, F.lit(k)), 4) for k in range(count)))


def seed(tag: str, *parts: Column) -> Column:
    """A digest (hex) that seeds a deterministic choice."""
    return F.sha2(F.concat_ws("|", F.lit(tag), *(p.cast("string") for p in parts)), 256)


def content_hash(row: Column) -> Column:
    """The digest of a struct's JSON."""
    return F.sha2(F.to_json(row), 256)
