"""Levels, explanations and note texts, as CASE expressions.

The texts are fixed values that reports and exports print.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import THREAT_LABELS
from .values import round_places


def is_threat(label: Column) -> Column:
    return label.isin(*THREAT_LABELS)


def live_level(label: Column, confidence: Column) -> Column:
    """Level of an alert from a captured flow. Null for normal flows."""
    return (
        F.when(label == "Malicious", F.when(confidence >= 0.9, "Critical").otherwise("High"))
        .when(label == "Suspicious", F.when(confidence >= 0.8, "Medium").otherwise("Low"))
    )


def import_level(watch_hit: Column, label: Column) -> Column:
    """Level of an alert from an imported flow: a watchlist hit goes first."""
    return (
        F.when(watch_hit, "High")
        .when(label == "Malicious", "Critical")
        .when(label == "Suspicious", "Medium")
    )


def import_alert_type(watch_hit: Column) -> Column:
    return F.when(watch_hit, "watchlist_match").otherwise("flow_classification")


def import_threat_type(watch_hit: Column) -> Column:
    return F.when(watch_hit, "IOC Watchlist Cross-Correlation Hit").otherwise(
        "Imported Volumetric / Flow Anomaly"
    )


def device_level(score: Column) -> Column:
    return F.when(score >= 0.85, "High").otherwise("Medium")


def device_status(recent_alert: Column, samples: Column, window: int = 20) -> Column:
    return (
        F.when(recent_alert, "Anomalous").when(samples <= window, "Warming Up").otherwise("Normal")
    )


def device_badge(recent_alert: Column, samples: Column, score: Column, window: int = 20) -> Column:
    """The badge of the device list, which judges by the last score as well."""
    status = device_status(recent_alert, samples, window)
    return (
        F.when((status == "Warming Up") | (samples < window), "Warming Up")
        .when(recent_alert | (score >= 0.70), "Anomalous Spike")
        .otherwise("Baseline Stable")
    )


def health_status(health: Column) -> Column:
    return F.when(health < 50, "Critical").when(health < 85, "Warning").otherwise("Optimal")


def is_simulated(source: Column) -> Column:
    return F.coalesce(source.startswith("sim:"), F.lit(False))


def provenance(kind: str, detail: Column | None = None) -> Column:
    """Source tag: ``live``, ``pcap:<file>``, ``import:<id>``, ``replay:<file>``, ``sim:<kind>``."""
    return F.lit(kind) if detail is None else F.concat(F.lit(f"{kind}:"), detail.cast("string"))


def explanation(label: Column, sbytes: Column, splt_mean: Column, packets: Column, size: Column) -> Column:
    """Threat type, reason, severity and action of one verdict, as a struct."""
    sbytes, splt_mean, packets, size = (c.cast("double") for c in (sbytes, splt_mean, packets, size))

    def verdict(threat: str, reason: Column | str, severity: str, action: str) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(
            F.lit(threat).alias("threat_type"),
            text.alias("reason"),
            F.lit(severity).alias("severity"),
            F.lit(action).alias("action"),
        )

    flood = verdict(
        "Potential DoS / Volumetric Flood",
        F.format_string(
            "High source data volume (%.0f bytes) over %.0f packets. Characteristically observed in "
            "volumetric DoS floods or large unauthorized transfers.",
            sbytes,
            packets,
        ),
        "Critical",
        "Investigate source IP connection rates. Verify affected service health and socket states.",
    )
    large = verdict(
        "Anomalous Volume / Potential Exfiltration",
        F.format_string(
            "Anomalously large average packet size (%.1f bytes) indicates heavy buffer utilization, "
            "characteristic of data staging or potential exfiltration.",
            round_places(size, 1),
        ),
        "High",
        "Inspect connection endpoint and audit active payload flows on the local subnet.",
    )
    deviating = verdict(
        "Anomalous Traffic Deviation",
        "Multi-feature statistical profile deviates significantly from established baseline "
        "characteristics.",
        "High",
        "Flag connection for investigation. Correlate with concurrent host activity logs.",
    )
    scan = verdict(
        "Possible Port Scan / Reconnaissance",
        F.format_string(
            "Abnormally compressed packet inter-arrival interval (%.6fs) indicates automated probing "
            "or rapid connection sweeps.",
            round_places(splt_mean, 6),
        ),
        "Medium",
        "Investigate originating host. Check for sequential destination port connections.",
    )
    probe = verdict(
        "Possible Port Probe",
        F.format_string(
            "Sparse single-packet flow (%.0f bytes, %.0f pkts) characteristic of exploratory TCP flag "
            "probing.",
            sbytes,
            packets,
        ),
        "Medium",
        "Monitor source IP for broader scanning activity across other local hosts.",
    )
    unusual = verdict(
        "Unusual Flow Characteristic",
        "Flow timing and packet size parameters exhibit minor divergence from typical traffic patterns.",
        "Low",
        "Maintain passive observation. No immediate intervention required.",
    )
    normal = verdict(
        "Normal Traffic",
        "Traffic patterns match standard operational baselines (balanced payload size and normal "
        "timing).",
        "Low",
        "No immediate response needed. Maintain active monitoring.",
    )
    return (
        F.when(label == "Normal", normal)
        .when((label == "Malicious") & ((sbytes > 15000) | (packets > 100)), flood)
        .when((label == "Malicious") & (size > 1000), large)
        .when(label == "Malicious", deviating)
        .when((splt_mean < 0.005) & (packets > 5), scan)
        .when((sbytes < 500) & (packets <= 2), probe)
        .otherwise(unusual)
    )


def with_context(text: Column, context: Column) -> Column:
    shown = context.isNotNull() & (context != "")
    return F.when(shown, F.concat(text, F.lit(" | Context: "), context)).otherwise(text)


def note(
    simulated: Column,
    src_ip: Column,
    dest_ip: Column,
    protocol: Column,
    threat_type: Column,
    reason: Column,
    action: Column,
    context: Column,
) -> Column:
    """Note of a live alert."""
    text = F.concat(
        F.when(simulated, "[SIMULATION] ").otherwise(""),
        F.lit("["),
        src_ip,
        F.lit(" -> "),
        dest_ip,
        F.lit(" | "),
        protocol,
        F.lit("] Diagnosis: "),
        threat_type,
        F.lit(" | Reason: "),
        reason,
        F.lit(" | Action: "),
        action,
    )
    return with_context(text, context)


def simulated_note(simulated: Column, notes: Column) -> Column:
    """A note with the mark of simulated traffic, which it may have already."""
    mark = simulated & ~notes.contains("[SIMULATION]")
    return F.when(mark, F.concat(F.lit("[SIMULATION] "), notes)).otherwise(notes)


def import_note(batch_id: Column, threat_type: Column, src_ip: Column, dest_ip: Column, protocol: Column, context: Column) -> Column:
    """Note of an alert raised by an imported flow."""
    text = F.concat(
        F.lit("[IMPORT BATCH #"),
        batch_id.cast("string"),
        F.lit("] "),
        threat_type,
        F.lit(" on "),
        src_ip,
        F.lit("->"),
        dest_ip,
        F.lit(" ("),
        protocol,
        F.lit(")"),
    )
    return with_context(text, context)


def parse_note(notes: Column) -> Column:
    """Threat type, reason and action read back from a note, with the default texts."""

    def part(name: str) -> Column:
        # A part runs to the next separator; the diagnosis follows the endpoints, not a separator.
        start = r"(?:^| \| |\] )" if name == "Diagnosis" else r"(?:^| \| )"
        found = F.regexp_extract(notes, rf"(?s){start}{name}: (.*?)(?: \| |$)", 1)
        return F.when(found != "", found)

    return F.struct(
        F.coalesce(part("Diagnosis"), F.lit("Anomaly Intrusion Signature")).alias("threat_type"),
        F.coalesce(
            part("Reason"),
            F.lit(
                "The classifier identified packet characteristics deviating significantly from normal "
                "baseline profiles."
            ),
        ).alias("reason"),
        F.coalesce(
            part("Action"),
            F.lit("Deploy perimeter firewall blocking rules against the offending source IP address."),
        ).alias("action"),
    )


def recommendations(score: Column) -> Column:
    """Advice lines for a threat score."""
    return (
        F.when(
            score > 70,
            F.array(
                F.lit(
                    "IMMEDIATELY deploy firewall blocking rules against active malicious source IPs to "
                    "secure network boundaries."
                ),
                F.lit(
                    "Throttle connection rates on affected interfaces and flag destination IPs for "
                    "potential containment."
                ),
            ),
        )
        .when(
            score > 30,
            F.array(
                F.lit(
                    "Flag suspicious devices for active monitoring. Inspect L7 DNS/HTTP query histories "
                    "for anomalies."
                ),
                F.lit(
                    "Conduct signature-level inspections on active protocols showing abnormal flow ratios."
                ),
            ),
        )
        .otherwise(
            F.array(
                F.lit("Continue running default passive monitoring sniffing threads."),
                F.lit(
                    "Periodically backup SQL flow records and capture local PCAPs to maintain streaming "
                    "accuracy indicators."
                ),
            )
        )
    )
