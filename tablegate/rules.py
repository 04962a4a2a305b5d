"""Rule tables: the closed sets, word lists and limits the checks compare against.

A rule book is configuration, not data.  It is held as plain Python values whose
size is checked on construction, and reaches the executors as literals inside
expressions, so comparing any number of names with every rule needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. They have to equal the published release rules for the results
# to be right.
# ---------------------------------------------------------------------------

MAX_NAME_LENGTH = 50
WARN_NAME_LENGTH = 30

BANNED_FAIL_RATIO = 85
BANNED_WARN_RATIO = 80
FILTER_FAIL_RATIO = 80
FILTER_WARN_RATIO = 70

SENTINEL = -999

SCHEMA_VERSION = 1.1

# An author's name and address; characters a tag may not hold.
AUTHOR_PATTERN = r"^.+?\s*<([^>]+)>$"
ILLEGAL = r"[^A-Za-z0-9_.;\-]"

SURVEYS = ("WAVES", "WAVES-4C3R2", "WAVES-StePS", "WAVES-ORCHIDSS")
DEFAULT_SURVEY = "WAVES"

LICENSES = ("Copyright WAVES [Private]", "MIT")
DEFAULT_LICENSE = "Copyright WAVES [Private]"

INTEGER_TYPES = ("int16", "int32", "int64")
FLOAT_TYPES = ("float32", "float64")
DATA_TYPES = ("int16", "int32", "int64", "float32", "float64", "boolean", "string")

# Table document: accepted keys in their required order, and the mandatory ones.
DOCUMENT_KEYS = (
    "survey", "dataset", "table", "version", "date", "author", "coauthors", "DOIs",
    "depends", "description", "comments", "license", "keywords", "MAML_version", "fields",
)
DOCUMENT_REQUIRED = (
    "survey", "dataset", "table", "version", "date", "author", "description",
    "license", "MAML_version", "fields",
)
FIELD_KEYS = ("name", "unit", "info", "ucd", "data_type", "qc")
FIELD_REQUIRED = ("name", "unit", "info", "ucd", "data_type")
QC_KEYS = ("min", "max")
DOI_KEYS = ("DOI", "type")
DEPENDS_KEYS = ("survey", "dataset", "table", "version")

# Rollup document: accepted keys in their required order, and the mandatory ones.
ROLLUP_KEYS = (
    "survey", "dataset", "version", "date", "author", "coauthors", "dois", "description",
    "comments", "license", "keywords", "ancillary", "tables",
)
ROLLUP_REQUIRED = (
    "survey", "dataset", "version", "date", "author", "description", "license", "tables",
)

# Vocabulary line types that may open a tag, and those that may follow.
PRIMARY_TYPES = ("Q", "P", "E", "V", "C")
SECONDARY_TYPES = ("Q", "S", "E", "V", "C")

NAMESPACES = ("ivoa",)

BANNED_WORDS = (
    "fred", "bob", "thing", "whatever", "words", "blahblahblah", "abc123", "xyz", "duff",
)

# name, unit, tag
EXCEPTION_WORDS = (("uberID", "unitless", "meta.id;meta.main"),)

# name, secondary tag
FILTER_NAMES = (
    ("FUV_GALEX", "em.UV.100-200nm"),
    ("NUV_GALEX", "em.UV.200-300nm"),
    ("u_SDSS", "em.opt.U"),
    ("g_SDSS", "em.opt"),
    ("r_SDSS", "em.opt.R"),
    ("i_SDSS", "em.opt.I"),
    ("z_SDSS", "em.opt"),
    ("u_VST", "em.opt.U"),
    ("g_VST", "em.opt"),
    ("r_VST", "em.opt"),
    ("i_VST", "em.opt.I"),
    ("Z_VISTA", "em.IR"),
    ("Y_VISTA", "em.IR.NIR"),
    ("J_VISTA", "em.IR.J"),
    ("H_VISTA", "em.IR.H"),
    ("K_VISTA", "em.IR.K"),
    ("W1_WISE", "em.IR.3-4um"),
    ("I1_Spitzer", "em.IR.3-4um"),
    ("I2_Spitzer", "em.IR.4-8um"),
    ("W2_WISE", "em.IR.4-8um"),
    ("I3_Spitzer", "em.IR.8-15um"),
    ("I4_Spitzer", "em.IR.15-30um"),
    ("W3_WISE", "em.IR.8-15um"),
    ("W4_WISE", "em.IR.15-30um"),
    ("M24_Spitzer", "em.IR.15-30um"),
    ("M70_Spitzer", "em.IR.60-100um"),
    ("P70_Herschel", "em.IR.60-100um"),
    ("P100_Herschel", "em.IR.60-100um"),
    ("P160_Herschel", "em.IR.FIR"),
    ("S250_Herschel", "em.IR.30-60um"),
    ("S350_Herschel", "em.IR.60-100um"),
    ("S450_JCMT", "em.mm.400-750GHz"),
    ("S500_Herschel", "em.mm.400-750GHz"),
    ("S850_JCMT", "em.mm.200-400GHz"),
    ("Band_ionising_photons", "em.UV.10-50nm"),
    ("Band9_ALMA", "em.mm.400-750GHz"),
    ("Band8_ALMA", "em.mm.400-750GHz"),
    ("Band7_ALMA", "em.mm.200-400GHz"),
    ("Band6_ALMA", "em.mm.200-400GHz"),
    ("Band5_ALMA", "em.mm.100-200GHz"),
    ("Band4_ALMA", "em.mm.100-200GHz"),
    ("Band3_ALMA", "em.mm.50-100GHz"),
    ("BandX_VLA", "em.radio.6-12GHz"),
    ("BandC_VLA", "em.radio.6-12GHz"),
    ("BandS_VLA", "em.radio.1500-3000MHz"),
    ("BandL_VLA", "em.radio.1500-3000MHz"),
    ("Band_610MHz", "em.radio.400-750MHz"),
    ("Band_325MHz", "em.radio.200-400MHz"),
    ("Band_150MHz", "em.radio.100-200MHz"),
)

# name, common mistakes, units, tags
PROTECTED_WORDS = (
    ("ra",
     ("ascension", "r.a.", "r_a", "ra_deg", "ra_(deg)", "ra_degrees", "right_ascension"),
     ("deg",), ("pos.eq.ra",)),
    ("dec",
     ("declination", "dec_deg", "dec (deg)", "dec degrees", "decl."),
     ("deg",), ("pos.eq.dec",)),
    ("vel",
     ("velocity", "vel_kms", "v_los", "vlos", "v_rad", "v(km/s)", "radial velocity"),
     ("km/s",), ("phys.veloc",)),
    ("mag",
     ("magnitude", "app_mag", "apparent_magnitude", "m_app"),
     ("mag",), ("phot.mag",)),
    ("mag_abs",
     ("absolute magnitude", "m_abs", "abs_mag", "M_abs"),
     ("mag",), ("phot.mag;phys.magAbs",)),
    ("err",
     ("error", "uncertainty", "stddev", "std", "measurement error"),
     ("various",), ("stat.error",)),
    ("flux_density",
     ("flux density", "f_nu", "fnu", "f_lambda", "flam", "fluxdens", "Snu"),
     ("Jy",), ("phot.flux.density",)),
    ("flux",
     ("total flux", "measured flux", "int_flux", "integrated flux", "f"),
     ("erg/s/cm^2",), ("phot.flux",)),
    ("luminosity",
     ("lum", "luminosity (erg/s)", "Lbol", "L_sun", "bolometric luminosity"),
     ("erg/s",), ("phys.luminosity",)),
    ("mass",
     ("stellar mass", "M", "Msol", "mass_msun", "mstar", "Mstar", "msun"),
     ("Msol",), ("phys.mass",)),
    ("sfr",
     ("star formation rate", "SFR_msun_yr", "sfr(msun/yr)"),
     ("Msol/yr",), ("phys.SFR",)),
    ("metallicity",
     ("gas metallicity", "stellar metallicity", "metal abundance"),
     ("dex",), ("phys.abund.Z",)),
    ("redshift",
     ("zobs", "z_spec", "z_phot", "spectroscopic redshift", "photometric redshift",
      "zcos", "z_obs"),
     ("unitless",), ("src.redshift",)),
    ("snr",
     ("signal to noise", "S/N", "sn_ratio", "signal/noise", "sn"),
     ("unitless",), ("stat.snr",)),
    ("ew",
     ("equivalent width", "eq width", "EW_line", "eqw"),
     ("Å",), ("spect.line.eqWidth",)),
    ("radius",
     ("rad", "r_phys", "r_ang", "radii", "object radius", "r (arcsec)", "r (kpc)"),
     ("arcsec", "kpc"), ("phys.size",)),
    ("sersic_index",
     ("n_sersic", "sersic n", "sersicn", "Sérsic index", "SersicN"),
     ("unitless",), ("src.sersic.index",)),
    ("axis_ratio",
     ("axrat", "axial_ratio", "b/a", "ellipticity", "axisratio"),
     ("unitless",), ("src.ellipticity",)),
    ("pos_ang",
     ("position angle", "pa", "posang", "P.A.", "PA(deg)", "position angle (deg)"),
     ("deg",), ("pos.posAng",)),
    ("line_width",
     ("linewidth", "line width", "FWHM", "sigma_line", "velocity_width", "dispersion"),
     ("km/s",), ("spect.line.width",)),
    ("sep",
     ("separation", "sep_dist", "distance between", "angular separation",
      "physical separation"),
     ("arcsec", "kpc"), ("pos.angDistance",)),
    ("pix",
     ("pixel", "pixels"),
     ("unitless",), ("instr.param;instr.pixel",)),
)

# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class ProtectedWord:
    name: str
    mistakes: tuple[str, ...]
    units: tuple[str, ...]
    tags: tuple[str, ...]


@dataclass(frozen=True)
class FilterName:
    name: str
    tag: str

    @property
    def inverse(self) -> str:
        return "_".join(reversed(self.name.split("_")))


@dataclass(frozen=True)
class ExceptionWord:
    name: str
    unit: str
    tag: str


@dataclass(frozen=True)
class RuleBook:
    """The word rules used by the name checks and by metadata inference."""

    protected: tuple[ProtectedWord, ...] = field(
        default_factory=lambda: tuple(ProtectedWord(*row) for row in PROTECTED_WORDS))
    filters: tuple[FilterName, ...] = field(
        default_factory=lambda: tuple(FilterName(*row) for row in FILTER_NAMES))
    exceptions: tuple[ExceptionWord, ...] = field(
        default_factory=lambda: tuple(ExceptionWord(*row) for row in EXCEPTION_WORDS))
    banned: tuple[str, ...] = BANNED_WORDS
    namespaces: tuple[str, ...] = NAMESPACES

    @classmethod
    def from_mappings(cls, protected=None, filters=None, exceptions=None, namespaces=None,
                      banned=BANNED_WORDS) -> "RuleBook":
        """Build a rule book from the mappings a rule file holds (name -> entry)."""
        given = {}
        if protected is not None:
            given["protected"] = tuple(
                ProtectedWord(name, tuple(dict.fromkeys(entry["common_mistakes"])),
                              tuple(entry["unit"]), tuple(entry["ucd"]))
                for name, entry in protected.items())
        if filters is not None:
            given["filters"] = tuple(
                FilterName(name, entry["secondary_ucd"]) for name, entry in filters.items())
        if exceptions is not None:
            given["exceptions"] = tuple(
                ExceptionWord(name, entry["unit"], entry["ucd"])
                for name, entry in exceptions.items())
        if namespaces is not None:
            given["namespaces"] = tuple(namespaces)
        return cls(banned=tuple(banned), **given)


DEFAULT_RULES = RuleBook()
