"""Rules, framework catalogs and snippets: small dimensions with fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    field: str
    conditions: tuple[tuple, ...]
    vendors: tuple[str, ...] = ("*",)
    os_families: tuple[str, ...] = ("*",)
    on_absent_default: str = "evaluate"
    on_absent_unsupported: str = "not_applicable"
    on_capability_unknown: str = "unknown"
    refs: tuple[tuple[str, str], ...] = ()
    gaps: tuple[tuple[str, str], ...] = dc_field(default=())

    @property
    def frameworks(self) -> tuple[str, ...]:
        return tuple(sorted({f for f, _ in self.refs}))


# The published checks.
BASE_RULES = (
    Rule("SSH-001", "high", "ssh_version", (("equals", 2),), refs=(("nist", "AC-17(02)"), ("stig", "CISC-ND-001210"), ("cis", "2.1.1.2"))),
    Rule("TELNET-001", "critical", "telnet_enabled", (("is_false",),), refs=(("nist", "CM-07"), ("nist", "AC-17(02)"))),
    Rule("HTTP-001", "high", "http_server_enabled", (("is_false",),), refs=(("nist", "CM-07"),)),
    Rule("TIMEOUT-001", "medium", "idle_timeout_seconds", (("gt", 0), ("lte", 600)), refs=(("nist", "AC-12"), ("cis", "1.2.8")),
         gaps=(("stig", "the standard requires five minutes or less"),)),
    Rule("LOGGING-001", "medium", "logging_hosts", (("non_empty",),), refs=(("nist", "AU-04(01)"),)),
    Rule("NTP-001", "low", "ntp_servers", (("non_empty",),), refs=(("nist", "SC-45(01)"), ("cis", "2.3.2"))),
    Rule("BANNER-001", "low", "banner_present", (("is_true",),), refs=(("nist", "AC-08"), ("cis", "1.3.3"))),
)

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3, "info": 0.1}
VERDICT_RANK = {"fail": 0, "unknown": 1, "pass": 2, "not_applicable": 3}
VERDICTS = ("pass", "fail", "unknown", "not_applicable")

FRAMEWORKS = ("cis", "nist", "stig", "iso")


@dataclass(frozen=True)
class Catalog:
    framework: str
    document: str
    edition: str
    covers: tuple[str, str, str] | None  # vendor, os_family, release pattern
    live: tuple[str, ...]
    withdrawn: tuple[str, ...] = ()


CATALOGS = (
    Catalog("nist", "NIST SP 800-53 Rev 5", "5.2.0", None,
            ("AC-17(02)", "CM-07", "AC-12", "SC-10", "AU-04(01)", "AU-09(02)", "SC-45(01)", "AC-08"), ("AC-13", "SC-09")),
    Catalog("cis", "CIS Cisco IOS XE 17.x Benchmark", "v2.2.1 (2025-07-17)", ("cisco", "ios", r"^17\."), ("2.1.1.2", "1.2.8", "2.3.2", "1.3.3")),
    Catalog("stig", "DISA Cisco IOS XE Router NDM STIG", "V3R7 (2026-04-01)", ("cisco", "ios", r"^1[67]\."), ("CISC-ND-001210", "CISC-ND-001200"), ("CISC-ND-000010",)),
)
