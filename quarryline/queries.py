"""Registry of queries() and oracle_sql() for the operators of the library."""

from quarryline.plans import audits, dialogues, facts, files, intake, lessons, records, rollouts, scans, selection, state, wire

QUERIES = selection.QUERIES | dialogues.QUERIES | facts.QUERIES | records.QUERIES | lessons.QUERIES | rollouts.QUERIES | intake.QUERIES | audits.QUERIES | files.QUERIES | scans.QUERIES | state.QUERIES | wire.QUERIES
ORACLES: dict[str, str] = selection.ORACLES | dialogues.ORACLES | facts.ORACLES | records.ORACLES | lessons.ORACLES | rollouts.ORACLES | intake.ORACLES | audits.ORACLES | files.ORACLES | scans.ORACLES | state.ORACLES | wire.ORACLES
