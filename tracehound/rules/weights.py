"""Weights, thresholds and ranges of the batch classifier, and the vote and layer scores of the file checks."""

from __future__ import annotations

# Feature weights per attack type.
ATTACK_WEIGHTS = {
    "bruteforce": {"failureRate": 0.95, "eventsPerMinute": 0.7, "uniqueSourceIps": -0.3, "uniqueTargetUsers": -0.4,
                   "burstiness": 0.6, "invalidUserRatio": 0.5},
    "password_spray": {"failureRate": 0.9, "uniqueTargetUsers": 0.95, "uniqueSourceIps": -0.3,
                       "targetUserEntropy": 0.8, "invalidUserRatio": 0.7},
    "dos": {"eventsPerMinute": 0.9, "uniqueSourceIps": 0.85, "burstiness": 0.9, "errorCodeRatio": 0.6, "smeansz": -0.3},
    "reconnaissance": {"uniquePorts": 0.8, "errorCodeRatio": 0.7, "uniqueTargetHosts": 0.6, "ct_src_dport_ltm": 0.7, "ct_dst_src_ltm": 0.5},
    "exploit": {"errorCodeRatio": 0.75, "sbytes": 0.6, "dbytes": 0.5, "suspiciousPatternCount": 0.85, "res_bdy_len": 0.7},
    "generic_attack": {"suspiciousPatternCount": 0.9, "errorCodeRatio": 0.8, "burstiness": 0.6},
    "normal": {"failureRate": -0.8, "errorCodeRatio": -0.7, "suspiciousPatternCount": -0.9},
    "analysis": {"eventsPerMinute": 0.5, "errorCodeRatio": 0.6},
    "backdoor": {"smeansz": 0.8, "dmeansz": 0.7},
    "fuzzer": {"burstiness": 0.9, "eventsPerMinute": 0.8, "smeansz": -0.5, "errorCodeRatio": 0.7,
               "suspiciousPatternCount": 0.6},
    "shellcode": {"sbytes": 0.7, "res_bdy_len": 0.8, "suspiciousPatternCount": 0.9},
    "worm": {"uniqueSourceIps": 0.8, "ct_srv_src": 0.7, "ct_srv_dst": 0.7},
    "sql_injection": {"suspiciousPatternCount": 0.95, "errorCodeRatio": 0.7, "res_bdy_len": 0.6},
    "xss_attack": {"suspiciousPatternCount": 0.9, "res_bdy_len": 0.7, "errorCodeRatio": 0.5},
    "path_traversal": {"suspiciousPatternCount": 0.9, "errorCodeRatio": 0.7, "res_bdy_len": 0.6},
    "command_injection": {"suspiciousPatternCount": 0.95, "errorCodeRatio": 0.7, "smeansz": 0.6},
    "privilege_escalation": {"privilegedUserRatio": 0.95, "failureRate": 0.6, "burstiness": 0.5},
    "lateral_movement": {"uniqueTargetHosts": 0.9, "ct_srv_src": 0.85, "ct_srv_dst": 0.8},
    "data_exfiltration": {"dbytes": 0.9, "dmeansz": 0.85, "offHoursActivity": 0.7},
    "port_scan": {"uniquePorts": 0.95, "ct_dst_src_ltm": 0.9, "failureRate": 0.6},
    "malware_activity": {"smeansz": 0.7, "dmeansz": 0.7, "offHoursActivity": 0.6},
    "c2_communication": {"eventsPerMinute": 0.7, "burstiness": 0.75, "offHoursActivity": 0.8},
    "insider_threat": {"offHoursActivity": 0.8, "privilegedUserRatio": 0.7, "dbytes": 0.6},
    "account_takeover": {"successAfterFailure": 0.9, "failureRate": 0.5},
    "mfa_bypass": {"mfaFailureRate": 0.95, "failureRate": 0.7},
    "mfa_fatigue": {"mfaFailureRate": 0.9, "eventsPerMinute": 0.85, "burstiness": 0.7},
    "session_hijacking": {"sourceIpEntropy": 0.8, "offHoursActivity": 0.6},
    "kerberoasting": {"uniqueTargetUsers": 0.85, "eventsPerMinute": 0.7, "privilegedUserRatio": 0.6},
    "pass_the_hash": {"uniqueTargetHosts": 0.7},
    "golden_ticket": {"privilegedUserRatio": 0.95, "uniqueTargetHosts": 0.85},
    "dns_tunneling": {"eventsPerMinute": 0.75, "dmeansz": 0.7, "offHoursActivity": 0.7},
    "cryptomining": {"suspiciousPatternCount": 0.7, "offHoursActivity": 0.4},
    "supply_chain": {"suspiciousPatternCount": 0.75},
    "file_inclusion": {"suspiciousPatternCount": 0.75, "errorCodeRatio": 0.6, "res_bdy_len": 0.5},
    "prototype_pollution": {"suspiciousPatternCount": 0.75, "errorCodeRatio": 0.5},
    "ssrf_attack": {"suspiciousPatternCount": 0.75, "errorCodeRatio": 0.5},
    "xxe_attack": {"suspiciousPatternCount": 0.75, "errorCodeRatio": 0.6, "res_bdy_len": 0.5},
    "log4shell": {"suspiciousPatternCount": 0.8},
    "apt_activity": {"suspiciousPatternCount": 0.75, "offHoursActivity": 0.7, "uniqueTargetHosts": 0.7},
    "zero_day_exploit": {"suspiciousPatternCount": 0.8, "errorCodeRatio": 0.7},
    "living_off_the_land": {"suspiciousPatternCount": 0.75, "privilegedUserRatio": 0.7},
    "anomaly": {"burstiness": 0.6},
    "ransomware": {"suspiciousPatternCount": 0.75, "actionVelocity": 0.8},
    "deserialization": {"suspiciousPatternCount": 0.8, "errorCodeRatio": 0.7, "res_bdy_len": 0.6},
    "webshell": {"suspiciousPatternCount": 0.8, "errorCodeRatio": 0.5, "offHoursActivity": 0.6},
}

# A type is reported from this score on.
ATTACK_THRESHOLDS = {
    "bruteforce": 0.85, "password_spray": 0.85, "dos": 0.85, "reconnaissance": 0.80, "exploit": 0.80,
    "generic_attack": 0.75, "normal": 0.3, "fuzzer": 0.80, "sql_injection": 0.80, "xss_attack": 0.80,
    "path_traversal": 0.80, "command_injection": 0.85, "data_exfiltration": 0.90, "port_scan": 0.80,
    "c2_communication": 0.90, "mfa_bypass": 0.90, "mfa_fatigue": 0.85, "log4shell": 0.75, "ransomware": 0.80,
    "deserialization": 0.90, "webshell": 0.80, "analysis": 0.75, "backdoor": 0.80, "shellcode": 0.80, "worm": 0.80,
    "privilege_escalation": 0.80, "lateral_movement": 0.85, "malware_activity": 0.85, "insider_threat": 0.85,
    "account_takeover": 0.90, "session_hijacking": 0.90, "kerberoasting": 0.85, "pass_the_hash": 0.90, "golden_ticket": 0.95,
    "dns_tunneling": 0.85, "cryptomining": 0.80, "supply_chain": 0.90, "file_inclusion": 0.85, "prototype_pollution": 0.85,
    "ssrf_attack": 0.85, "xxe_attack": 0.85, "apt_activity": 0.90, "zero_day_exploit": 0.95, "living_off_the_land": 0.85,
    "anomaly": 0.75,
}

# Value ranges used to bring features to 0..1.
FEATURE_RANGES = {
    "sbytes": (0, 10000000), "dbytes": (0, 10000000), "smeansz": (0, 1500), "dmeansz": (0, 1500),
    "res_bdy_len": (0, 1000000), "eventsPerMinute": (0, 1000), "burstiness": (0, 2), "offHoursActivity": (0, 1),
    "uniqueSourceIps": (0, 1000), "uniqueTargetUsers": (0, 500), "uniqueTargetHosts": (0, 500),
    "targetUserEntropy": (0, 10), "failureRate": (0, 1), "mfaFailureRate": (0, 1), "invalidUserRatio": (0, 1),
    "uniquePorts": (0, 65535), "errorCodeRatio": (0, 1), "suspiciousPatternCount": (0, 100),
    "actionVelocity": (0, 100), "ct_srv_src": (0, 100), "ct_srv_dst": (0, 100), "ct_src_dport_ltm": (0, 100), "ct_dst_src_ltm": (0, 100),
    "privilegedUserRatio": (0, 1), "successAfterFailure": (0, 100), "sourceIpEntropy": (0, 10),
}

# Layer points, severity points and check weights of the file checks.
LAYER_POINTS = {"si_fn": 30.0, "usn": 30.0, "logfile": 20.0, "external": 20.0, "events": 15.0}
SEVERITY_POINTS = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50, "LOW": 25, "INFO": 0}
CHECK_WEIGHTS = {1: 1.2, 2: 1.5, 4: 1.5, 5: 1.5, 7: 1.3}
ROUND_DELTAS = [3600, 7200, 86400, 172800, 604800, 2592000, 31536000]
