"""DataFrame operators: frontier (J1, J2, U1, L1, L3), company (J3-J5),
asof (J6, J7, C4), stats (A1-A10, W1-W3, C5), extract (H2-H9),
articles (P1, P2, P8-P10, C1-C3)."""
