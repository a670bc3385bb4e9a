"""Where bars, company info and symbols come from and go to."""
