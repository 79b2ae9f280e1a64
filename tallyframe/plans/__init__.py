"""Shared plan shapes: fitted statistics, exact quantiles, ordered scans."""
