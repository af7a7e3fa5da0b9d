"""Plans: documents and a ruleset to findings, statistics, fixes and listings."""
