"""Column builders. They stay inside the JVM: no Python runs per row."""
