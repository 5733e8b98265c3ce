"""The binary wire layout of messages as column expressions: encode, lengths, decode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of the five message kinds, magic byte of an envelope.
TAGS = {"gossip": 1, "ihave": 2, "graft": 3, "prune": 4, "sync": 5}
MAGIC = "50"
ID_BYTES, MAX_IDS = 24, 64


def hex_be(column: Column, bytes_: int) -> Column:
    """A non-negative number as big-endian hexadecimal of fixed width."""
    return F.lower(F.lpad(F.hex(column.cast("long")), 2 * bytes_, "0"))


def number(hexed: Column, start: int, bytes_: int) -> Column:
    """The big-endian number of ``bytes_`` bytes at byte ``start`` of a hexadecimal string."""
    return F.conv(F.substring(hexed, 1 + 2 * start, 2 * bytes_), 16, -10).cast("long")


def encode_id(ts: Column, counter: Column, rnd: Column) -> Column:
    """24 bytes: three big-endian 64-bit numbers."""
    return F.concat(hex_be(ts, 8), hex_be(counter, 8), hex_be(rnd, 8))


def short_id(ts: Column, counter: Column, rnd: Column) -> Column:
    """A 16-digit label: low 32 bits of ts, low 16 of counter and random. Not unique."""
    low = lambda c, bits: c.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return F.concat(hex_be(low(ts, 32), 4), hex_be(low(counter, 16), 2), hex_be(low(rnd, 16), 2))


def encode_message(kind: Column, id_hex: Column, round_: Column, payload: Column) -> Column:
    """Hexadecimal of a message of ``kind``: one id in an announcement, the payload in a gossip message."""
    body = F.lower(F.hex(F.coalesce(payload, F.lit("")).cast("binary")))
    return (
        F.when(kind == "gossip", F.concat(F.lit("01"), id_hex, hex_be(round_, 4), hex_be(F.octet_length(F.coalesce(payload, F.lit(""))), 4), body))
        .when(kind == "ihave", F.concat(F.lit("02"), hex_be(round_, 4), F.lit("0001"), id_hex))
        .when(kind == "graft", F.concat(F.lit("03"), id_hex, hex_be(round_, 4)))
        .when(kind == "prune", F.lit("04"))
    )


def encoded_length(kind: Column, payload: Column, ids: Column) -> Column:
    """Length in bytes without encoding."""
    return (
        F.when(kind == "gossip", 33 + F.octet_length(F.coalesce(payload, F.lit(""))))
        .when(kind == "ihave", 7 + ID_BYTES * ids)
        .when(kind == "graft", F.lit(29))
        .when(kind == "prune", F.lit(1))
        .cast("long")
    )


def decode_message(hexed: Column) -> Column:
    """struct(tag, ts, counter, rnd, round, payload); null for unknown tags, cut-off frames and too many ids."""
    size = F.length(hexed) / 2
    tag = number(hexed, 0, 1)
    at = lambda start: [number(hexed, start + 8 * i, 8) for i in range(3)]
    null = F.lit(None)

    def row(ids: list[Column], round_: Column, payload: Column) -> Column:
        return F.struct(
            tag.alias("tag"), ids[0].alias("ts"), ids[1].alias("counter"), ids[2].alias("rnd"), round_.alias("round"), payload.alias("payload")
        )

    none = [null.cast("long")] * 3
    text = null.cast("string")
    length = number(hexed, 29, 4)
    return (
        F.when(
            (tag == 1) & (size >= 33) & (size >= 33 + length),
            row(at(1), number(hexed, 25, 4), F.unhex(F.substr(hexed, F.lit(67), (2 * length).cast("int"))).cast("string")),
        )
        .when((tag == 2) & (size >= 7) & number(hexed, 5, 2).between(1, MAX_IDS) & (size >= 7 + 24 * number(hexed, 5, 2)), row(at(7), number(hexed, 1, 4), text))
        .when((tag == 3) & (size >= 29), row(at(1), number(hexed, 25, 4), text))
        .when(tag == 4, row(none, null.cast("long"), text))
    )


#: The priority class of each message kind.
PRIORITIES = {"gossip": "high", "ihave": "normal", "graft": "critical", "prune": "low", "sync": "normal"}


def priority(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])[kind]


def encode_bare(message: Column) -> Column:
    """A frame without a sender: the magic byte and the message."""
    return F.concat(F.lit(MAGIC), message)


def encode_envelope(sender: Column, message: Column) -> Column:
    """A frame: the magic byte, the sender as a big-endian 64-bit number, the message."""
    return F.concat(F.lit(MAGIC), hex_be(sender, 8), message)


def envelope_length(message_length: Column) -> Column:
    return 1 + 8 + message_length


def is_frame(hexed: Column) -> Column:
    """Whether bytes start with the magic byte."""
    return F.coalesce(F.substring(hexed, 1, 2) == MAGIC, F.lit(False))


def decode_envelope(hexed: Column) -> Column:
    """struct(sender, message); null for another magic byte, a cut-off sender, or a message that doesn't decode."""
    message = decode_message(F.substr(hexed, F.lit(19)))
    return F.when(is_frame(hexed) & (F.length(hexed) >= 20) & message.isNotNull(), F.struct(number(hexed, 1, 8).alias("sender"), message.alias("message")))


def decode_bare(hexed: Column) -> Column:
    return F.when(is_frame(hexed), decode_message(F.substr(hexed, F.lit(3))))


def encode_announcement(ids: Column, round_: Column) -> Column:
    """An announcement of an array of encoded ids, up to ``MAX_IDS``; null beyond."""
    return F.when(F.size(ids) <= MAX_IDS, F.concat(F.lit("02"), hex_be(round_, 4), hex_be(F.size(ids), 2), F.array_join(ids, "")))


def announced_ids(hexed: Column) -> Column:
    """All ids of an announcement, as hexadecimal; null for other frames and cut-off ones."""
    n = number(hexed, 5, 2)
    whole = (number(hexed, 0, 1) == 2) & n.between(1, MAX_IDS) & (F.length(hexed) >= 14 + 48 * n)
    return F.when(whole, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substr(hexed, (15 + 48 * i).cast("int"), F.lit(48))))


def debug_id(ts: Column, counter: Column, rnd: Column) -> Column:
    """The full-width label of an id."""
    return F.concat(F.lit("MessageId("), F.concat_ws("-", hex_be(ts, 8), hex_be(counter, 8), hex_be(rnd, 8)), F.lit(")"))


#: Tags of the four synchronisation frames, most ids and most messages of a frame.
SYNC_TAGS = {"request": 5, "response": 6, "pull": 7, "push": 8}
MAX_SYNC_IDS, MAX_SYNC_MESSAGES = 100, 50


def _flag(c: Column) -> Column:
    return F.when(c, "01").otherwise("00")


def encode_sync_request(root_hex: Column, start: Column, end: Column) -> Column:
    """A 32-byte digest and the time range that it covers."""
    return F.concat(F.lit("05"), F.lower(root_hex), hex_be(start, 8), hex_be(end, 8))


def encode_sync_response(matches: Column, has_more: Column, ids: Column) -> Column:
    return F.concat(F.lit("06"), _flag(matches), _flag(has_more), hex_be(F.size(ids), 2), F.array_join(ids, ""))


def encode_sync_pull(ids: Column) -> Column:
    return F.concat(F.lit("07"), hex_be(F.size(ids), 2), F.array_join(ids, ""))


def encode_sync_push(messages: Column) -> Column:
    """``messages``: array of struct(id (hexadecimal), round, payload)."""

    def one(m: Column) -> Column:
        payload = F.coalesce(m["payload"], F.lit(""))
        return F.concat(m["id"], hex_be(m["round"], 4), hex_be(F.octet_length(payload), 4), F.lower(F.hex(payload.cast("binary"))))

    return F.concat(F.lit("08"), hex_be(F.size(messages), 2), F.array_join(F.transform(messages, one), ""))


def sync_length(kind: Column, ids: Column, messages: Column) -> Column:
    """Bytes of a frame of ``kind``, from its number of ids or its array of messages, without encoding."""
    pushed = F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + 32 + F.octet_length(F.coalesce(m["payload"], F.lit(""))))
    return (
        F.when(kind == "request", F.lit(49))
        .when(kind == "response", 5 + ID_BYTES * ids)
        .when(kind == "pull", 3 + ID_BYTES * ids)
        .when(kind == "push", 3 + pushed)
        .cast("long")
    )


def decode_sync_request(hexed: Column) -> Column:
    """struct(root, start, end); null for other tags and cut-off frames."""
    whole = (number(hexed, 0, 1) == 5) & (F.length(hexed) >= 98)
    return F.when(whole, F.struct(F.substring(hexed, 3, 64).alias("root"), number(hexed, 33, 8).alias("start"), number(hexed, 41, 8).alias("end")))


def _id_list(hexed: Column, at: int) -> Column:
    """The ids counted by the two bytes at byte ``at``; null over the limit and where bytes lack."""
    n = number(hexed, at, 2)
    cut = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.substr(hexed, (2 * at + 5 + 48 * (i - 1)).cast("int"), F.lit(48)))
    some = F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))
    return F.when((n <= MAX_SYNC_IDS) & (F.length(hexed) >= 2 * at + 4 + 48 * n), some)


def decode_sync_response(hexed: Column) -> Column:
    """struct(matches, has_more, ids); null for other tags, cut-off frames and too many ids."""
    ids = _id_list(hexed, 3)
    whole = (number(hexed, 0, 1) == 6) & ids.isNotNull()
    return F.when(whole, F.struct((number(hexed, 1, 1) != 0).alias("matches"), (number(hexed, 2, 1) != 0).alias("has_more"), ids.alias("ids")))


def decode_sync_pull(hexed: Column) -> Column:
    """The ids asked for; null for other tags, cut-off frames and too many ids."""
    return F.when(number(hexed, 0, 1) == 7, _id_list(hexed, 1))


def decode_sync_push(hexed: Column) -> Column:
    """Array of struct(id, round, payload); null for other tags, cut-off frames and too many messages.

    The frame is turned into bytes once, as a byte range is cut without counting characters before it.
    """
    n = number(hexed, 1, 2)
    row = "struct<id:string,round:bigint,payload:string>"
    turns = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(True).alias("whole"), F.array().cast(f"array<{row}>").alias("rows"))

    def messages(frame: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            part = lambda offset, width: F.substr(frame, (a["at"] + 1 + offset).cast("int"), width.cast("int"))
            whole_number = lambda offset: F.conv(F.hex(part(offset, F.lit(4))), 16, 10).cast("long")
            length = whole_number(28)
            whole = a["whole"] & (F.octet_length(frame) >= a["at"] + 32) & (F.octet_length(frame) >= a["at"] + 32 + length)
            message = F.struct(F.lower(F.hex(part(0, F.lit(24)))).alias("id"), whole_number(24).alias("round"), part(32, length).cast("string").alias("payload"))
            return F.when(
                whole, F.struct((a["at"] + 32 + length).alias("at"), F.lit(True).alias("whole"), F.concat(a["rows"], F.array(message).cast(f"array<{row}>")).alias("rows"))
            ).otherwise(F.struct(a["at"].alias("at"), F.lit(False).alias("whole"), a["rows"].alias("rows")))

        return F.aggregate(turns, start, step, lambda a: F.when(a["whole"], a["rows"]))

    good = (number(hexed, 0, 1) == 8) & (F.length(hexed) >= 6) & (n <= MAX_SYNC_MESSAGES)
    return F.when(good, F.try_element_at(F.transform(F.array(F.unhex(hexed)), messages), F.lit(1)))


def encode_topic_message(topic: Column, publisher: Column, sequence: Column, ts: Column, payload: Column) -> Column:
    """A topic with its 16-bit length, three 64-bit numbers, and the payload to the frame's end."""
    text = lambda c: F.lower(F.hex(F.coalesce(c, F.lit("")).cast("binary")))
    return F.concat(hex_be(F.octet_length(F.coalesce(topic, F.lit(""))), 2), text(topic), hex_be(publisher, 8), hex_be(sequence, 8), hex_be(ts, 8), text(payload))


def decode_topic_message(hexed: Column) -> Column:
    """struct(topic, publisher, sequence, ts, payload); null for cut-off frames."""
    n = F.when(F.length(hexed) >= 8, number(hexed, 0, 2))
    at = lambda offset: F.conv(F.substr(hexed, (5 + 2 * n + offset).cast("int"), F.lit(16)), 16, -10).cast("long")
    return F.when(
        F.length(hexed) >= 4 + 2 * n + 48,
        F.struct(
            F.unhex(F.substr(hexed, F.lit(5), (2 * n).cast("int"))).cast("string").alias("topic"),
            at(0).alias("publisher"),
            at(16).alias("sequence"),
            at(32).alias("ts"),
            F.unhex(F.substr(hexed, (53 + 2 * n).cast("int"))).cast("string").alias("payload"),
        ),
    )


#: The fields of each kind of event, beside its type.
EVENT_FIELDS = {
    "sent": ["peers"],
    "received": ["from", "method"],
    "graft": ["to", "msg_id"],
    "prune": ["to"],
    "promote": ["peer"],
    "demote": ["peer"],
    "offline": [],
    "online": [],
    "join": ["peer"],
    "leave": ["peer"],
    "quic_connect": ["peer", "rtt_ms"],
    "quic_disconnect": ["peer", "reason"],
    "quic_migrate": ["peer", "new_addr"],
}


def event_json(kind: Column, fields: dict[str, Column]) -> Column:
    """An event as a JSON object with its type, keys in alphabetical order; null for an unknown kind. An id shows its first 8 characters."""
    found = F.lit(None).cast("string")
    for name, wanted in EVENT_FIELDS.items():
        given = {f: fields[f] for f in wanted if f in fields} | {"type": F.lit(name)}
        if "msg_id" in given:
            given["msg_id"] = F.substring(given["msg_id"], 1, 8)
        found = F.when(kind == name, F.to_json(F.struct(*[given[f].alias(f) for f in sorted(given)]))).otherwise(found)
    return found


def duration_text(ms: Column) -> Column:
    return F.concat(ms.cast("long").cast("string"), F.lit("ms"))


def duration_ms(text: Column) -> Column:
    """Milliseconds of a text such as 250ms or 250; null for anything else."""
    return F.regexp_extract(F.when(text.rlike(r"^\+?[0-9]+(ms)*$"), text), r"^\+?([0-9]+)", 1).try_cast("long")


def socket_address(text: Column) -> Column:
    """struct(host, port) of host:port or [v6]:port; null for anything else."""
    shape = r"^(\[[0-9A-Fa-f:.]+\]|[^:\s\[\]]+):([0-9]{1,5})$"
    port = F.regexp_extract(F.when(text.rlike(shape), text), shape, 2).try_cast("int")
    return F.when(port <= 65535, F.struct(F.regexp_extract(text, shape, 1).alias("host"), port.alias("port")))
