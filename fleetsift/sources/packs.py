"""Platform dimensions: detection signatures, identity patterns, field patterns, rules.

These are fixed values that must equal the published packs for results to agree.  They are
small (tens of rows); operators unroll them into literal regexes, which lets Spark compile
each pattern once.  A deployment passes its own lists of the same shape.
"""

from __future__ import annotations

from fleetsift.sources.literals import Literal

MIN_SCORE = 0.60
MIN_MARGIN = 0.25

# vendor, os_family, kind, pattern, weight
SIGNATURES = [
    ("cisco", "ios", "regex", r"^version \d+\.\d+", 0.25),
    ("cisco", "ios", "regex", r"^service timestamps ", 0.25),
    ("cisco", "ios", "regex", r"^line vty \d+", 0.2),
    ("cisco", "ios", "regex", r"^interface (GigabitEthernet|FastEthernet)\d", 0.2),
    ("cisco", "ios", "regex", r"^ip ssh version ", 0.15),
    ("cisco", "nxos", "regex", r"^(no )?feature \S+$", 0.35),
    ("cisco", "nxos", "regex", r"^vrf context \S+$", 0.3),
    ("cisco", "nxos", "regex", r"^line vty$", 0.25),
    ("cisco", "nxos", "regex", r"^logging server \S+", 0.2),
    ("arista", "eos", "regex", r"^! device: \S+ \(", 0.35),
    ("arista", "eos", "regex", r"^transceiver qsfp default-mode ", 0.3),
    ("arista", "eos", "regex", r"^management api http-commands", 0.25),
    ("arista", "eos", "regex", r"^interface Ethernet\d", 0.2),
    ("arista", "eos", "regex", r"^line vty \d+", 0.05),
    ("juniper", "junos", "regex", r"^set system host-name ", 0.35),
    ("juniper", "junos", "regex", r"^set version ", 0.25),
    ("juniper", "junos", "regex", r"^set interfaces \S+ unit \d+", 0.25),
    ("juniper", "junos", "regex", r"^set security ", 0.2),
    ("juniper", "junos", "regex", r"^system \{$", 0.3),
    ("juniper", "junos", "regex", r"^interfaces \{$", 0.25),
    ("juniper", "junos", "regex", r"^firewall \{$", 0.2),
    ("juniper", "junos", "regex", r"^routing-options \{$", 0.15),
    ("juniper", "junos", "regex", r"^version \d+\.\d+R\S*;$", 0.25),
]

# vendor, os_family, field, pattern (declaration order matters)
IDENTITIES = [
    ("cisco", "ios", "hostname", r"^hostname (\S+)"),
    ("cisco", "ios", "os_version", r"^version (\S+)"),
    ("cisco", "nxos", "hostname", r"^hostname (\S+)"),
    ("cisco", "nxos", "os_version", r"^version (\S+) Bios:"),
    ("arista", "eos", "hostname", r"^hostname (\S+)"),
    ("arista", "eos", "os_version", r"^! device: \S+ \([^,]+, EOS-(\S+)\)"),
    ("arista", "eos", "model", r"^! device: \S+ \(([^,]+), EOS-\S+\)"),
    ("juniper", "junos", "hostname", r"^set system host-name (\S+)"),
    ("juniper", "junos", "os_version", r"^set version (\S+)"),
    ("juniper", "junos", "hostname", r"^\s+host-name (\S+);$"),
    ("juniper", "junos", "os_version", r"^version (\d+\.\d+R\S*);$"),
]
IDENTITY_FIELDS = ("hostname", "model", "os_version", "serial", "domain_name")

# os_family -> syntax mode, and the mode a Junos file takes when a line opens a block
SYNTAX_MODE = {"ios": "indent", "eos": "indent", "nxos": "indent", "junos": "set_path"}
BLOCK_OPENER = r"^\S.*\{\s*$"

COMMENT_PREFIXES = {"ios": ["!"], "nxos": ["!"], "eos": ["!"], "junos": []}

# os_family -> (opener, group of the captured terminator)
LITERAL_BLOCKS = {"ios": [(r"^banner \S+ (\S+)$", 1)]}

_VTY = [r"^line vty \d+ \d+$"]
# vendor, os_family, id, field, scope (None root only, [] any depth), pattern, capture, cast, source
PATTERNS = [
    ("cisco", "ios", "p-ssh-version-001", "ssh_version", None, r"^ip ssh version (\d+)$", "$1", "int", "builtin"),
    ("cisco", "ios", "p-telnet-enabled-001", "telnet_enabled", _VTY, r"^transport input (?=.*\btelnet\b).*$", "true", "bool", "builtin"),
    ("cisco", "ios", "p-telnet-enabled-002", "telnet_enabled", _VTY, r"^transport input (?:ssh|none)$", "false", "bool", "builtin"),
    ("cisco", "ios", "p-http-server-001", "http_server_enabled", None, r"^no ip http server$", "false", "bool", "builtin"),
    ("cisco", "ios", "p-http-server-002", "http_server_enabled", None, r"^ip http server$", "true", "bool", "builtin"),
    ("cisco", "ios", "p-https-server-001", "https_server_enabled", None, r"^ip http secure-server$", "true", "bool", "builtin"),
    ("cisco", "ios", "p-idle-timeout-001", "idle_timeout_seconds", _VTY, r"^exec-timeout (\d+) (\d+)$", "$1 $2", "duration", "builtin"),
    ("cisco", "ios", "p-logging-host-001", "logging_hosts", None, r"^logging host (\S+)$", "$1", "list", "builtin"),
    ("cisco", "ios", "p-ntp-server-001", "ntp_servers", None, r"^ntp server (\S+)$", "$1", "list", "builtin"),
    ("cisco", "ios", "p-banner-present-001", "banner_present", None, r"^banner motd (\S+)$", "true", "bool", "builtin"),
    ("cisco", "nxos", "p-nxos-telnet-001", "telnet_enabled", None, r"^no feature telnet$", "false", "bool", "builtin"),
    ("cisco", "nxos", "p-nxos-telnet-002", "telnet_enabled", None, r"^feature telnet$", "true", "bool", "builtin"),
    ("cisco", "nxos", "p-nxos-http-001", "http_server_enabled", None, r"^no ip http server$", "false", "bool", "builtin"),
    ("cisco", "nxos", "p-nxos-idle-timeout-001", "idle_timeout_seconds", [r"^line vty$"], r"^exec-timeout (\d+)$", "$1", "duration_minutes", "builtin"),
    ("cisco", "nxos", "p-nxos-logging-host-001", "logging_hosts", None, r"^logging server (\S+)", "$1", "list", "builtin"),
    ("cisco", "nxos", "p-nxos-ntp-001", "ntp_servers", None, r"^ntp server (\S+)", "$1", "list", "builtin"),
    ("cisco", "nxos", "p-nxos-banner-001", "banner_present", None, r"^banner motd ", "true", "bool", "builtin"),
    ("cisco", "nxos", "p-nxos-aaa-001", "aaa_enabled", None, r"^aaa authentication login default ", "true", "bool", "builtin"),
]

# Interface blocks, and the child lines read from them, per platform
INTERFACES = {
    ("cisco", "ios"): {
        "block": r"^interface (\S+)$", "description": r"^description (.+)$", "ip_address": r"^ip address (\S+) (\S+)$",
        "shutdown": r"^shutdown$", "no_shutdown": r"^no shutdown$", "applied": r"^ip access-group (\S+) (in|out)$",
    },
    ("cisco", "nxos"): {
        "block": r"^interface (\S+)$", "description": r"^description (.+)$", "ip_address": r"^ip address (\S+)$",
        "shutdown": r"^shutdown$", "no_shutdown": r"^no shutdown$", "applied": r"^ip access-group (\S+) (in|out)$",
    },
}

# Access lists per platform: dialect, block header, remark
ACL_DIALECTS = {
    ("cisco", "ios"): {"dialect": "ios_wildcard", "block": r"^ip access-list extended (\S+)$", "remark": r"^remark (.*)$"},
    ("cisco", "nxos"): {"dialect": "nxos_cidr", "block": r"^ip access-list (\S+)$", "remark": None},
}

CANONICAL_FIELDS = [
    "ssh_version", "telnet_enabled", "http_server_enabled", "https_server_enabled", "min_password_length",
    "idle_timeout_seconds", "logging_enabled", "logging_hosts", "ntp_servers", "snmp_v3_only",
    "banner_present", "aaa_enabled", "weak_ciphers",
]

# How a field resolves when its lines disagree; a field not named stays undecided.
MERGE_POLICY = {"telnet_enabled": "worst_case_true"}

# What an input type cannot carry, whatever the pack says.
SOURCE_LIMITS = Literal(
    "source_limit",
    "source_type string, field string, note string",
    [("cli", "serial", "A serial number is inventory data and is not part of a configuration export.")],
)

PACKS = sorted({(v, o) for v, o, *_ in SIGNATURES})
