"""Live operators over landed log files: verdicts, ssh pairing, the ban ledger and its sweeps."""
