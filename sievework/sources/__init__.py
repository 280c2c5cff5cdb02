"""Dataset files, benchmark references and report files."""
