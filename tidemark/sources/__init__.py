"""Sources and sinks: N-Triples, log and document stores on any Hadoop path, JDBC, Kafka, connect-style records, result formats."""
