"""What a packet payload says about the application: HTTP, TLS and DNS."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def server_name(hello: bytes | None) -> str | None:
    """Server name in a TLS ClientHello (RFC 8446 4.1.2, RFC 6066 3), or None."""
    # Record header 5 bytes, handshake header 4, version 2, random 32: the session id is at 43.
    if hello is None or len(hello) < 44 or hello[0] != 22 or hello[5] != 1:
        return None

    def uint16(at: int) -> int:
        return int.from_bytes(hello[at : at + 2], "big")

    at = 44 + hello[43]  # after the session id
    at += 2 + uint16(at)  # after the cipher suites
    if at >= len(hello):
        return None
    at += 1 + hello[at]  # after the compression methods
    end = min(at + 2 + uint16(at), len(hello))
    at += 2
    while at + 4 <= end:
        kind, size = uint16(at), uint16(at + 2)
        at += 4
        # server_name: list length 2, name type 1, name length 2, name
        if kind == 0 and at + 5 <= len(hello) and hello[at + 2] == 0:
            name = hello[at + 5 : at + 5 + uint16(at + 3)]
            if len(name) == uint16(at + 3):
                return name.decode("utf-8", "ignore")
        at += size
    return None


def query_name(message: bytes | None) -> str | None:
    """Name in the first question of a DNS message (RFC 1035 4.1), or None."""
    if message is None or len(message) < 17 or int.from_bytes(message[4:6], "big") == 0:
        return None
    labels, at = [], 12
    while at < len(message) and message[at]:
        size = message[at]
        if size > 63 or at + 1 + size > len(message):
            return None
        labels.append(message[at + 1 : at + 1 + size].decode("utf-8", "ignore"))
        at += 1 + size
    return ".".join(labels) if at < len(message) else None


@F.pandas_udf(T.StringType())
def tls_server_name(payload: pd.Series) -> pd.Series:
    return payload.map(server_name)


@F.pandas_udf(T.StringType())
def dns_query_name(payload: pd.Series) -> pd.Series:
    return payload.map(query_name)


def _application(protocol: Column, src_port: Column, dest_port: Column, payload: Column, sni: Column, dns: Column) -> Column:
    text = F.decode(payload, "ISO-8859-1")
    filled = F.length(payload) > 0
    is_http = text.rlike(r"^(GET |POST |HTTP/1\.)")
    host = F.regexp_extract(text, r"(?is)\r\n[Hh][Oo][Ss][Tt]:[ \t]*([^\r\n]*)", 1)
    request = F.regexp_extract(text, r"^([^\r]*)", 1)
    is_tls_port = (src_port == 443) | (dest_port == 443)

    def app(name: str, info: Column) -> Column:
        return F.struct(F.lit(name).alias("protocol_l7"), info.alias("info"))

    host = F.trim(host)
    return (
        F.when((protocol == "UDP") & dns.isNotNull(), app("DNS", F.concat(F.lit("DNS Query: "), dns)))
        .when(
            (protocol == "TCP") & filled & is_http,
            app(
                "HTTP",
                F.when(host != "", F.concat(F.lit("HTTP Host: "), host)).otherwise(
                    F.concat(F.lit("HTTP: "), request)
                ),
            ),
        )
        .when(
            (protocol == "TCP") & filled & is_tls_port,
            app(
                "HTTPS",
                F.when(
                    sni.isNotNull() & (sni != ""), F.concat(F.lit("HTTPS/TLS SNI: "), sni)
                ).otherwise(F.lit("HTTPS/TLS Session")),
            ),
        )
    )


def application(protocol: Column, src_port: Column, dest_port: Column, payload: Column) -> Column:
    """``struct(protocol_l7, info)`` of a packet, null where the payload tells nothing.

    Only payloads that can hold a TLS hello or a DNS question go to Python; the rest stays null
    there and is decided by the JVM expressions.
    """
    hello = F.when((protocol == "TCP") & (F.substring(payload, 1, 1) == F.unhex(F.lit("16"))), payload)
    dns_port = src_port.isin(53, 5353) | dest_port.isin(53, 5353)
    question = F.when((protocol == "UDP") & dns_port, payload)
    return _application(protocol, src_port, dest_port, payload, tls_server_name(hello), dns_query_name(question))


def http_application(protocol: Column, src_port: Column, dest_port: Column, payload: Column) -> Column:
    """Same without TLS names and DNS questions: no Python at all."""
    nothing = F.lit(None).cast("string")
    return _application(protocol, src_port, dest_port, payload, nothing, nothing)
