"""Where lines, angles and calibration frames come from, and where results go."""
