"""Column functions: text (F1-F8), URLs (P4-P7, F4, F13), dates (F9),
HTML selection (H1), price labels (F10, F11)."""
