"""Column expressions shared by the operators. Everything here stays inside the JVM."""
