import ipaddress
import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowlens.functions import values as V


def column(spark, texts, fn):
    """Values of ``fn`` over the texts, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def python_ip(text):
    try:
        return str(text).strip() if text and ipaddress.ip_address(text.strip()) else None
    except ValueError:
        return None


def test_ip_agrees_with_python(spark):
    rng = random.Random(1)
    texts = ["10.0.0.5", " 10.0.0.5\t", "999.1.1.1", "010.0.0.1", "", None, "host", "1.2.3", "1.2.3.4.5", "::", "::1",
             "2001:db8::1", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":::",
             "fe80::1%eth0", "fe80::1%", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5::1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
             "12345::", "g::1", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7", "1.2.3.256", "1.2.3.4%x", "::1.2.3.04"]
    for _ in range(2000):
        parts = [rng.choice(["", "0", "1", "ab", "ffff", "12345", "1.2.3.4", "g"]) for _ in range(rng.randint(2, 9))]
        texts.append(":".join(parts))
    got = column(spark, texts, V.clean_ip)
    assert got == [python_ip(t) for t in texts]


def python_port(text):
    if text is None or text.strip() == "":
        return 0
    try:
        p = int(float(text))
        return p if 0 <= p <= 65535 else None
    except (ValueError, OverflowError):
        return None


def test_ports(spark):
    texts = ["80", " 53 ", "80.7", "", None, "70000", "-1", "-0.5", "x", "1e3", "nan", "inf", "65535.9", "1_000", "1__0",
             "0x10", "1d", "1f", "+5", ".5", "5.", ".", "65536"]
    assert column(spark, texts, V.clean_port) == [python_port(t) for t in texts]


def test_numbers(spark):
    texts = ["1.5", "-3", "abc", "", None, "NaN", "inf", "1e2", " 7 ", "1_0.5_0", "1d"]
    want = [1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 100.0, 7.0, 10.5, 0.0]
    assert column(spark, texts, V.clean_number) == want
    assert column(spark, ["9.9", "", "nan"], lambda c: V.clean_number(c, default=5.0, floor=1.0)) == [9.9, 5.0, 1.0]
    assert column(spark, ["12.9", "1e30", "-1"], V.clean_count) == [12, 0, 0]


def python_time(text):
    """The rules in plain Python; None where the caller has to fall back."""
    try:
        num = float(text)
        if num > 1e11:
            return datetime.fromtimestamp(num / 1000.0, tz=timezone.utc)
        if num > 1e8:
            return datetime.fromtimestamp(num, tz=timezone.utc)
    except ValueError:
        pass
    try:
        t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    except ValueError:
        pass
    for layout in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y/%m/%d %H:%M:%S"):
        try:
            return datetime.strptime(text.strip(), layout).replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    return None


def test_times(spark):
    texts = ["1700000000", "1700000000000", "1700000000.25", "1700000000123", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05",
             "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05.123456", "2024-01-02", "2024-01-02T03:04", "31/12/2024 10:00:00",
             "12/31/2024 10:00:00", "01/02/2024 10:00:00", "2024/12/31 10:00:00", "2024-1-2 3:4:5", "soon", "123", "99999999",
             "20240102", "20240102T030405", "2024-13-01", "1e12", "2024-01-02 03:04:05.5", "32/12/2024 10:00:00", "-1700000000",
             "2024-02-30T00:00:00", "99999999999999999"]
    got = column(spark, texts, lambda c: F.unix_micros(V.parse_time(c)))
    want = []
    for text in texts:
        try:
            t = python_time(text)
        except (ValueError, OverflowError, OSError):
            t = None
        want.append(None if t is None else round(t.timestamp() * 1e6))
    assert got == want


def test_protocols(spark):
    texts = ["tcp", " 6", "IPPROTO_UDP", "17", "1", "tls", "", None, "GRE", "dns"]
    assert column(spark, texts, V.protocol_name) == ["TCP", "TCP", "UDP", "UDP", "ICMP", "TLS", "OTHER", "OTHER", "GRE", "DNS"]
    names = ["TCP", "TLS", "DNS", "ARP", "ICMP", "GRE", "OTHER"]
    assert column(spark, names, V.protocol_id) == [1, 1, 2, 2, 3, 0, 0]
    assert column(spark, names, V.flow_protocol_id) == [1, 0, 0, 0, 3, 0, 0]
    assert column(spark, ["tcp", "UDP", "ICMPv6", "DNS"], V.device_protocol_id) == [6, 17, 1, 0]


def test_labels(spark):
    texts = ["BENIGN", "0", "normal", "1", "dDoS", "PortScan", "probe", "Worms", "", None, " dos "]
    want = ["Normal", "Normal", "Normal", "Malicious", "Malicious", "Malicious", "Suspicious", None, None, None, "Malicious"]
    assert column(spark, texts, V.ground_truth) == want


@pytest.mark.parametrize("places", [1, 2, 4, 6])
def test_rounding_is_that_of_the_binary_value(spark, places):
    rng = random.Random(places)
    values = [0.0, 0.35, 2.675, 2889.25, 0.25, 0.125, 1.005, 99.95, 0.5, 1e-9, 12345.6789, 1234.35]
    values += [rng.randrange(10**6) / rng.randrange(1, 999) for _ in range(500)]
    values += [rng.randrange(10**7) / 10 ** (places + 1) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r.x for r in df.select("i", V.round_places(F.col("v"), places).alias("x")).orderBy("i").collect()]
    assert got == [round(v, places) for v in values]
    assert not any(math.isnan(x) for x in got)
