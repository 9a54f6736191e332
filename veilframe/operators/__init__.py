"""DataFrame operators: detection, corpus scans, treatments, risk, utility, report."""
