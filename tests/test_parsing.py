"""Golden lines per format, grouping and readers."""

import pytest
from pyspark.sql import functions as F

from tracehound.functions import normalize as nz
from tracehound.operators import parsing as ps
from tracehound.rules.formats import RAW
from tracehound.sources import readers, sinks

GOLDEN = [
    ('Jan 14 18:55:21 ftp-prod vsftpd[11119]: [backup_user] OK LOGIN: Client "198.51.100.42"', "VSFTPD", {"username": "backup_user", "status": "ok", "action": "login", "client_ip": "198.51.100.42"}),
    ("(000001)01/14/2026 18:55:15 - alice (66.249.66.1)> 230 User alice logged in", "FileZilla FTP", {"username": "alice", "ip": "66.249.66.1", "status_code": "230"}),
    ("Wed Jan 14 18:55:15 2026 25 172.16.5.21 12766578 /home/guest/notes.txt b _ i a guest ftp 0 * c", "xferlog", {"direction": "incoming", "access_mode": "anonymous", "username": "guest", "file_type": "binary"}),
    ("2026-01-14 18:55:07 103.21.244.11 dev01 192.168.1.1 21 PASS - 530 0 0", "IIS FTP", {"client_ip": "103.21.244.11", "username": "dev01", "method": "PASS", "status": "530"}),
    ('10.0.0.5 - - [10/Jan/2026:02:56:02] "POST / HTTP/1.1" 500 708', "Apache", {"ip": "10.0.0.5", "request": "POST / HTTP/1.1", "status": "500", "bytes": "708"}),
    ('10.0.0.5 - bob [10/Jan/2026:02:56:02] "POST / HTTP/1.1" 500 708', "NGINX", {"ip": "10.0.0.5", "user": "bob", "status": "500"}),
    ("PUT /settings 200", "Flask", {"method": "PUT", "path": "/settings", "status": "200"}),
    ('[10/Jan/2026:02:56:02] "PUT /" 401', "Django", {"method": "PUT", "status": "401"}),
    ("GET /settings 401 40ms", "Node.js", {"method": "GET", "status": "401", "duration_ms": "40"}),
    ("2024-01-01T00:04:43.000Z 89 [ERROR] [MY-001064] [Server] You have an error in your SQL syntax", "MySQL Error", {"error_level": "error", "error_code": "001064", "thread_id": "89"}),
    ('2024-01-01 00:03:14.000 UTC [7475] readonly@staging ERROR: 42P01: relation "inventory" does not exist', "PostgreSQL Error", {"username": "readonly", "database": "staging", "level": "error"}),
    ("2025-09-15 00:00:49.147 PST [17508] STATEMENT: SELECT ip_address, name FROM staging.payments WHERE id = 8712901;", "PostgreSQL Statement", {"timezone": "PST", "pid": "17508"}),
    ("2024-01-01 00:13:27.000 Logon Server Error: 1205, Severity: 13, State: 68. Transaction...", "SQL Server Error", {"error_number": "1205", "state": "68"}),
    ("01-JAN-2026 00:00:06 * (CONNECT_DATA=(SERVICE_NAME=crmdb)) * (ADDRESS=(PROTOCOL=tcp)(HOST=172.3.232.14)(PORT=12169)) * establish * crmdb * 0", "Oracle Listener", {"service_name": "crmdb", "host": "172.3.232.14", "port": "12169", "action": "establish", "result": "0"}),
    ('{"t":{"$date":"2024-06-01T00:00:00.135000Z"},"s":"I","c":"NETWORK","msg":"client conn closed","attr":{"remote":"100.65.28.6:46015"}}', "MongoDB Server", {"severity": "info", "component": "NETWORK", "remote": "100.65.28.6:46015"}),
    ("Jan 13 14:54:30 server kernel: IPTABLES-DROP: IN=eth0 OUT= MAC=aa:bb:cc SRC=172.16.0.2 DST=10.0.0.5 PROTO=ICMP SPT=443 DPT=22", "iptables", {"action": "drop", "src_ip": "172.16.0.2", "dst_port": "22"}),
    ("2026-01-13 14:54:30 ALLOW ICMP 127.0.0.1 172.16.0.2 22 443", "Windows Firewall", {"action": "allow", "src_port": "22", "dst_port": "443"}),
    ("2026/01/13 14:54:30 allow udp 172.16.0.2 172.16.0.2 rule=Block_HTTP", "Palo Alto Firewall", {"rule": "Block_HTTP", "action": "allow"}),
    ("date=2026-01-13 time=14:54:30 action=allow srcip=127.0.0.1 dstip=10.0.0.5 service=HTTP", "FortiGate", {"src_ip": "127.0.0.1", "timestamp": "2026-01-13 14:54:30"}),
    ("Jan 13 14:54:30 firewall %ASA-6-106100: access-list outside_access_in permitted tcp outside/127.0.0.1 to inside/192.168.1.10", "Cisco ASA", {"action": "permitted", "src_ip": "127.0.0.1", "dst_ip": "192.168.1.10"}),
    ("Jan 10 09:00:01 web01 sshd[1122]: Accepted password for alice from 192.0.2.10 port 53412 ssh2", "Linux Syslog", {"process": "sshd", "pid": "1122"}),
    ("Jan 13 10:56:03 mailserver postfix/cleanup[5550]: 4C1E538D63: from=<user@example.com>, to=<admin@example.org>, status=bounced", "Postfix", {"service": "postfix/cleanup", "pid": "5550", "user": "user@example.com"}),
    ("2026-01-13 10:56:03 HHVTKB5I3PCB => user@example.com H=mail.example.com [192.168.1.10]", "Exim", {"direction": "outgoing", "ip": "192.168.1.10"}),
    ("Jan 13 10:56:03 mailserver dovecot: imap-login: Login: user=<bob>, rip=192.168.1.10", "Dovecot", {"user": "bob", "remote_ip": "192.168.1.10", "login_type": "login"}),
    ("just some words", RAW, None),
]


def lines(spark, texts, source="s"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(texts)], "source STRING, line_no BIGINT, line STRING")


def test_golden_lines(spark):
    df = ps.extract_fields(lines(spark, [g[0] for g in GOLDEN]).withColumn("line_type", F.element_at(
        F.array(*[F.lit(g[1]) for g in GOLDEN]), (F.col("line_no") + 1).cast("int"))))
    for r in df.collect():
        want = GOLDEN[r.line_no][2]
        if want is None:
            assert r.fields is None
        else:
            assert r.fields is not None, GOLDEN[r.line_no][1]
            assert {k: r.fields.get(k) for k in want} == want


def test_line_types(spark):
    wanted = {i: g[1] for i, g in enumerate(GOLDEN)}
    # the earlier of two types that both take the line
    wanted.update({0: "Linux Syslog", 2: "Oracle Alert", 7: RAW, 20: "Linux SSHD Accepted"})
    got = {r.line_no: r.line_type for r in ps.line_type(lines(spark, [g[0] for g in GOLDEN])).collect()}
    assert got == wanted


def test_source_vote_needs_three(spark):
    ssh = "Jan 10 09:00:01 web01 sshd[1122]: Failed password for bob from 192.0.2.10 port 53412 ssh2"
    a = lines(spark, [ssh] * 3 + ["x"] * 5, "few").unionByName(lines(spark, ["x y z"] * 30, "none"))
    got = {r.source: (r.source_type, r.score) for r in ps.detect_source_type(a, 100, 10).collect()}
    assert got == {"few": ("Linux SSHD Failed", 9), "none": (RAW, 20)}


def group_reference(texts, opening, blank):
    out, cur = [], []
    for t in texts:
        if blank(t):
            if cur:
                out.append("\n".join(cur))
            cur = []
        elif opening(t) and cur:
            out.append("\n".join(cur))
            cur = [t]
        else:
            cur.append(t)
    if cur:
        out.append("\n".join(cur))
    return out


@pytest.mark.parametrize("width", [2, 1000])
def test_group_entries(spark, width):
    texts = ["tail of something", "2024-01-01 10:00:00 start", "  at line 1", "Caused by: x", "", "  indented first", "more", "ERROR: second", "plain", "", "", "end"]
    want = group_reference(texts, lambda t: t.startswith(("2024", "ERROR")), lambda t: not t.strip())
    got = [r.entry for r in ps.group_entries(lines(spark, texts), width).orderBy("line_no").collect()]
    assert got == want


def test_oracle_blocks(spark):
    texts = ["noise", "Mon Jan 05 10:00:00 2026", "ORA-00600: internal error", "more", "Tue Jan 06 10:00:00 2026", "Completed: ALTER DATABASE"]
    got = ps.parse_blocks(ps.group_blocks(lines(spark, texts), "oracle_alert"), "oracle_alert").orderBy("line_no").collect()
    assert [(r.error_code, r.severity) for r in got] == [("00600", "error"), (None, "info")]


def test_generic_fields_first_key_wins(spark):
    r = ps.generic_fields(lines(spark, ["user=bob USER=eve src_ip=1.2.3.4 to 5.6.7.8 status=404 GET /x"])).first()
    assert r.fields["user"] == "bob" and r.fields["src_ip"] == "1.2.3.4" and r.fields["dst_ip"] == "5.6.7.8" and r.fields["method"] == "GET"


def test_timestamps(spark):
    texts = ["Jan  5 01:02:03 host x", "at 10/Feb/2024:01:02:03 x", "2024-03-04T05:06:07Z x", "2024-03-04 05:06:07 x", "nothing"]
    df = lines(spark, texts).select("line_no", nz.line_ts(F.col("line"), F.create_map(F.lit("a"), F.lit("b")), 2023).alias("t"))
    got = [str(r.t) for r in df.orderBy("line_no").collect()]
    assert got == ["2023-01-05 01:02:03", "2024-02-10 01:02:03", "2024-03-04 05:06:07", "2024-03-04 05:06:07", "None"]
    alone = spark.range(1).select(nz.normalize_ts(F.lit("2024-03-04T05:06:07.123456Z"), 2023).alias("t")).first()
    assert alone.t.microsecond == 123456


def test_read_lines_keeps_order_over_splits(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(f"line {i}\n".encode() for i in range(5000)) + b"bad \xff byte\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
        assert spark.read.text(str(tmp_path / "a.log")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows[:5000]] == [f"line {i}" for i in range(5000)]
    assert [r.line_no for r in rows] == list(range(5001)) and rows[-1].line == "bad  byte"


def test_windows_csv_and_export(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "TimeCreated,EventID,LevelDisplayName,LogName,MachineName,Message,AccountName,LogonType,IpAddress\n"
        '2026-01-01 10:00:00,4625,Audit Failure,Security,pc1,"failed, twice",CORP\\bob,3,10.0.0.1\n')
    r = readers.read_windows_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [(x.event_id, x.severity, x.message, x.account_name, x.ip) for x in r] == [(4625, "error", "failed, twice", "CORP\\bob", "10.0.0.1")]


def test_export_and_feedback_files(spark, tmp_path, sf):
    from tracehound.operators.detect import tag_keywords
    from tracehound.plans import views

    e = tag_keywords(views.entries(spark, sf))
    ids = e.where("is_anomaly").select("id")
    for fmt in ("csv", "json", "text"):
        sinks.export_entries(e, ids, fmt, str(tmp_path / fmt))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == ids.count() == spark.read.json(str(tmp_path / "json")).count()
    fb = views.feedback(spark, sf)
    sinks.append_feedback(fb, str(tmp_path / "fb"))
    sinks.append_feedback(fb, str(tmp_path / "fb"))
    assert spark.read.parquet(str(tmp_path / "fb")).count() == 2 * fb.where("user_label <> 'bogus'").count()


def test_event_xml_file(spark, tmp_path):
    (tmp_path / "e.xml").write_text(
        '<Events><Event><System><EventID>4625</EventID><Level>2</Level><TimeCreated SystemTime="2026-01-01T00:00:01.5Z"/><EventRecordID>7</EventRecordID>'
        '<Channel>Security</Channel><Computer>pc</Computer></System><EventData><Data Name="IpAddress">10.0.0.1</Data></EventData></Event></Events>')
    r = readers.read_event_xml(spark, str(tmp_path / "e.xml")).first()
    assert (r.event_id, r.level, r.channel, r.event_data) == (4625, "Error", "Security", {"IpAddress": "10.0.0.1"})


def test_artifact_folder(spark, tmp_path):
    for i in (0, 1):
        (tmp_path / f"timeline_partition_{i}.txt").write_text("r/r\ta.txt\t2024-01-01 00:00:00 (UTC)\tx\ty\t2024-01-02 00:00:00 (UTC)\n")
        for k in ("usn_journal", "mft", "logs", "registry", "shadow_copies", "hidden_structures"):
            (tmp_path / f"{k}_partition_{i}.txt").write_text("Log cleared\n")
    a = readers.load_artifacts(spark, str(tmp_path))
    assert sorted(r.partition for r in a["timeline"].select("partition").collect()) == [0, 1]
    assert readers.parse_file_timeline(a["timeline"]).count() == 1


def test_fractions_and_offsets_of_times(spark):
    lines = {
        "2024-03-01T10:00:00.250Z x": "2024-03-01 10:00:00.25", "at 2024-03-01 10:00:00,125 x": "2024-03-01 10:00:00.125", "2024-03-01T10:00:00+02:00 x": "2024-03-01 08:00:00",
        "2024-03-01T10:00:00.5-0330 x": "2024-03-01 13:30:00.5", '1.1.1.1 - - [01/Mar/2024:10:00:00 +0100] "GET /"': "2024-03-01 09:00:00", "[01/Mar/2024:10:00:00] x": "2024-03-01 10:00:00",
        "Mar  1 10:00:00 h": "2024-03-01 10:00:00", "nothing": None,
    }
    df = spark.createDataFrame([(x,) for x in lines], "line STRING")
    out = df.select("line", nz.line_ts(F.col("line"), F.create_map(F.lit("k"), F.lit("v")), 2024).cast("string").alias("ts"))
    assert {r.line: r.ts for r in out.collect()} == lines
