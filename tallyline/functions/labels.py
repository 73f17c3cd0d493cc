"""Display labels of features."""

# --- Fixed values -----------------------------------------------------------
PAIRED_LABELS = {
    "matches_before_diff": "historical match experience",
    "win_rate_before_diff": "historical win rate",
    "wins_last_5_diff": "wins in last 5",
    "win_rate_last_5_diff": "last-5 win rate",
    "wins_last_10_diff": "wins in last 10",
    "win_rate_last_10_diff": "last-10 win rate",
    "wins_last_20_diff": "wins in last 20",
    "win_rate_last_20_diff": "last-20 win rate",
    "h2h_team_wins_diff": "head-to-head wins",
    "h2h_team_win_rate_diff": "head-to-head win rate",
    "h2h_last_5_win_rate_diff": "recent head-to-head form",
    "team_matches_at_venue_diff": "venue experience",
    "team_win_rate_at_venue_diff": "venue win rate",
    "team_elo_before_diff": "Elo rating",
    "previous_xi_core_batting_recent_runs_diff": "previous-XI core batting runs",
    "previous_xi_core_batting_recent_strike_rate_diff": "previous-XI core strike rate",
    "previous_xi_core_bowling_recent_wickets_diff": "previous-XI core wickets",
    "previous_xi_core_bowling_recent_economy_diff": "previous-XI core economy",
}
LIVE_LABELS = {
    "runs": "current score",
    "wickets": "wickets lost",
    "legal_balls_bowled": "balls bowled",
    "balls_remaining": "balls remaining",
    "current_run_rate": "current run rate",
    "wickets_in_hand": "wickets in hand",
    "target": "target",
    "runs_required": "runs required",
    "required_run_rate": "required run rate",
    "run_rate_difference": "current minus required run rate",
    "matches_before": "historical match experience",
    "win_rate_before": "historical win rate",
    "win_rate_last_5": "last-5 win rate",
    "win_rate_last_10": "last-10 win rate",
    "win_rate_last_20": "last-20 win rate",
    "h2h_team_win_rate": "head-to-head win rate",
    "team_win_rate_at_venue": "venue win rate",
    "elo_difference": "Elo advantage",
    "xi_batters_with_history": "XI batting-history coverage",
    "xi_mean_batting_average": "XI batting average",
    "xi_mean_recent_runs": "XI recent runs",
    "xi_bowlers_with_history": "XI bowling-history coverage",
    "xi_mean_bowling_economy": "XI bowling economy",
    "xi_mean_recent_wickets": "XI recent wickets",
    "toss_bat_signed": "toss/bat context",
    "toss_field_signed": "toss/field context",
    "is_t20i": "T20I format indicator",
    "is_male": "male-match indicator",
}
# ----------------------------------------------------------------------------
