"""Column expressions shared by the operators. No UDFs: all of it stays in the JVM."""
